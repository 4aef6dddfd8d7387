"""Queries over whole designs bring each line to its design once, whatever they work out of it."""

import re

from pigmentum.plans import QUERIES
from pigmentum.sources import fixtures

D = "/root/testdata/sf0.001"


def plan(spark, df) -> str:
    """The plan as for large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scans(text: str, column: str) -> int:
    return len(re.findall(rf"Scan parquet .*\[[^\]]*\b{column}#", text))


def shuffles(text: str) -> int:
    return len(re.findall(r"\bExchange (?:hash|single|range|Round)", text))


def test_texts_and_layers(spark):
    """Lines are shuffled by part and by design; parts and orders once."""
    for name in ("fx_texts", "fx_layers"):
        text = plan(spark, lambda: fixtures.view(spark, D, name))
        assert scans(text, "l_orderkey") == 1 and shuffles(text) == 4


def test_scores(spark):
    """Layout alone and with type and colour: one scan of the lines, no shuffle after those that make texts of them but the join with palettes."""
    for name, more in (("agg_17_layout_score", 0), ("agg_18_dna", 2)):
        text = plan(spark, lambda: QUERIES[name](spark, D))
        assert scans(text, "l_orderkey") == 1 and shuffles(text) == 4 + more and "Expand" not in text


def test_search(spark):
    """No shuffle on what is asked for, which a few values would make of a few tasks; each table is read once, and only if it answers."""
    for name, lines in (("qry_05_text_role_intent", 1), ("qry_04_background_intent", 1), ("qry_09_full_text", 2), ("qry_01_smart_search", 4)):
        text = plan(spark, lambda: QUERIES[name](spark, D))
        assert scans(text, "l_orderkey") == lines
        assert not re.search(r"hashpartitioning\((?:arg|role|kind)#", text) and "BroadcastNestedLoopJoin BuildLeft" not in text


def test_documents(spark):
    """A design's layers, texts and pictures come from one gathering of its lines; only the palette is joined."""
    for name, parts in (("snk_07_svg", 0), ("snk_09_layer_document", 1), ("snk_10_node_document", 1), ("snk_11_page_document", 1)):
        text = plan(spark, lambda: QUERIES[name](spark, D))
        assert scans(text, "l_orderkey") == 1 and shuffles(text) == 4 + parts


def test_scene_layers(spark):
    """A frame's pixels are gathered once; its boxes and layers are worked out beside them."""
    text = plan(spark, lambda: QUERIES["ras_14_scene_layers"](spark, D))
    assert shuffles(text) == 1 and "Join" not in re.sub("BroadcastNestedLoopJoin|CartesianProduct", "", text)
