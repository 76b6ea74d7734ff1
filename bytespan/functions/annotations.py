"""Column functions on annotation fields (PRJ1-PRJ6, FN8, PRJ13, PRJ14, FN13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source annotation type -> entity class (16 entries).
DEFAULT_TYPES = {
    "Uniprot": "proteingene",
    "protein": "proteingene",
    "NCBI gene": "proteingene",
    "gene": "proteingene",
    "CHEBI": "smallmolecule",
    "PubChem": "smallmolecule",
    "molecule": "smallmolecule",
    "GO": "cellularcomponent",
    "subcellular": "cellularcomponent",
    "CVCL": "celltypeline",
    "CL": "celltypeline",
    "cell": "celltypeline",
    "Uberon": "tissuesorgans",
    "tissue": "tissuesorgans",
    "NCBI taxon": "organismsspecies",
    "organism": "organismsspecies",
}

# Source types that are dropped.
EXCLUDED_TYPES = ("BAO", "Rfam", "Corum")

# The line separator removed from passage text (U+2028).
LINE_SEPARATOR = "\u2028"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_type(col) -> Column:
    """PRJ1: text before the first '_', then before the first ':'."""
    return F.substring_index(F.substring_index(_c(col), "_", 1), ":", 1)


def map_type(col, table: dict | None = None, strict: bool = True) -> Column:
    """PRJ2: source type -> entity class via a literal map; unknown raises."""
    table = table or DEFAULT_TYPES
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    v = m[_c(col)]
    if strict:
        v = F.coalesce(v, F.raise_error(F.concat(F.lit("unknown annotation type: "), _c(col))).cast("string"))
    return v


def exclude_types(df: DataFrame, col: str = "type", types=EXCLUDED_TYPES) -> DataFrame:
    """PRJ3: drop rows whose (normalised) type is excluded."""
    return df.filter(~F.col(col).isin(list(types)))


def clean_id(col) -> Column:
    """PRJ4: spaces in document ids become '|'."""
    return F.translate(_c(col), " ", "|")


def clean_text(col) -> Column:
    """PRJ4: remove the U+2028 line separator from passage text."""
    return F.replace(_c(col), F.lit(LINE_SEPARATOR), F.lit(""))


def format_triples(spans) -> Column:
    """PRJ6 + SRT1: ``S<start> L<len> <type>`` triples, greatest start first,
    space-joined (the target line of a document)."""
    s = F.reverse(F.sort_array(F.transform(_c(spans), lambda x, i: F.struct(
        x["start"].alias("start"), i.alias("ord"), x["len"].alias("len"), x["type"].alias("type")))))
    return F.array_join(F.transform(s, lambda x: F.concat(
        F.lit("S"), x["start"].cast("string"), F.lit(" L"), x["len"].cast("string"), F.lit(" "), x["type"])), " ")


def parse_triples(line) -> Column:
    """PRJ5: ``S12 L3 type ...`` -> array<struct<start,len,type>> (fields in
    threes, the number after the letter)."""
    f = F.split(F.trim(_c(line)), " +")
    f = F.when(F.trim(_c(line)) == "", F.array().cast("array<string>")).otherwise(f)

    def made(f: Column) -> Column:   # the fields, split once
        n = (F.size(f) / 3).cast("int")   # none on an unannotated line
        return F.transform(
            F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), n),
            lambda k: F.struct(F.substring(F.get(f, k * 3), 2, 1 << 30).cast("int").alias("start"),
                               F.substring(F.get(f, k * 3 + 1), 2, 1 << 30).cast("int").alias("len"),
                               F.get(f, k * 3 + 2).alias("type")))

    return F.transform(F.array(f), made)[0]


def zero_digits(col) -> Column:
    """FN8: every ASCII digit becomes 0."""
    return F.regexp_replace(_c(col), "[0-9]", "0")


def argmax_tag(scores) -> Column:
    """PRJ13: per position the index of the first maximum score."""
    return F.transform(_c(scores), lambda x: F.array_position(x, F.array_max(x)).cast("int") - 1)


def tag_scores(scores, tags: list[str]) -> Column:
    """PRJ14: per position an array of (tag, score)."""
    t = F.array(*[F.lit(x) for x in tags])
    return F.transform(_c(scores), lambda x: F.arrays_zip(t.alias("tag"), x.alias("score")))


def normalized_ll(ll, W: int) -> Column:
    """FN13: log-likelihood divided by the window length (padding included)."""
    return _c(ll) / F.lit(float(W))
