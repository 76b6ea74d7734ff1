"""BioC XML reader on a hand-made two-document file."""

import os
import tempfile

from pyspark.sql import functions as F

from bytespan.functions import annotations as an
from bytespan.sources.formats import read_bioc

XML = """<?xml version="1.0" encoding="UTF-8"?>
<collection>
<document><id>d 1</id>
<passage><offset>0</offset><text>IL-2 binds cells</text>
<annotation id="1"><infon key="type">Uniprot:P60568</infon><location offset="0" length="4"/><text>IL-2</text></annotation>
<annotation id="2"><infon key="type">CL_0000084</infon><location offset="11" length="5"/><text>cells</text></annotation>
</passage></document>
<document><id>d2</id>
<passage><offset>0</offset><text>no entities</text></passage></document>
</collection>
"""


def test_read_bioc(spark):
    d = tempfile.mkdtemp(prefix="bs-bioc-")
    with open(os.path.join(d, "a.xml"), "w") as f:
        f.write(XML)
    with open(os.path.join(d, "skip.txt"), "w") as f:
        f.write("not xml")
    rows = read_bioc(spark, d)
    got = rows.filter(F.col("raw_type").isNotNull()).select(
        an.clean_id("doc_key").alias("k"), an.map_type(an.norm_type("raw_type")).alias("t"), "ann_text").collect()
    assert sorted((r.k, r.t, r.ann_text) for r in got) == [("d|1", "celltypeline", "cells"),
                                                           ("d|1", "proteingene", "IL-2")]
