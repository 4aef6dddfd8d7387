"""Smart search: a phrase becomes one intent by ordered rules, and the intent a filter over a design's tables.

The rules are one CASE expression, so a table of queries is compiled to intents in one pass; hits
come from equality joins of intents with the elements they ask for.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..functions.numeric import half_up
from ..functions.text import LEFT, RIGHT, word

# Words of the query language, rules in the order in which they are tried.
COLOR_WORDS = ["red", "orange", "yellow", "green", "teal", "blue", "purple", "pink", "brown", "black", "white", "grey", "gray", "gold"]
COLOR_NOUNS = "colou?rs?|palette|hex|shades?"
BACKGROUND_WORDS = "backgrounds?|textures?|blur|overlay|lighting"
BACKGROUND_KINDS = "texture|blur|overlay|lighting|gradient"
TEXT_ROLES = [
    ("headlines?|titles?", "headline", "Headlines"),
    ("sub-?headlines?|subtitles?", "subheadline", "Sub-headlines"),
    ("captions?", "caption", "Captions"),
    ("stat(?:istic)?s?|numbers?", "statistic", "Statistics"),
    ("scores?|results?", "score", "Scores"),
    ("dates?|when", "date", "Dates"),
    ("names?", "name", "Names"),
    ("body|paragraphs?", "body", "Body text"),
    ("cta|buttons?", "cta", "Calls to action"),
]
TEXT_WORDS = "text|words|copy|typography|fonts?"
OBJECT_WORDS = [
    ("(?:player|athlete|people|person|persons|human|model|figure)s?", "person", "", "People & players"),
    ("faces?", "face", "", "Faces"),
    ("sponsors?", "logo", "sponsor", "Sponsor logos"),
    ("(?:badge|crest|team logo)s?", "logo", "badge|crest|team", "Team badges"),
    ("(?:logo|brand|brand ?mark)s?", "logo", "", "Logos & brand marks"),
    ("icons?", "icon", "", "Icons"),
    ("products?", "product", "", "Products"),
    ("(?:vehicle|car|bike|truck)s?", "vehicle", "", "Vehicles"),
    ("(?:building|architecture|stadium)s?", "building", "", "Buildings"),
    ("(?:image|images|object|objects|asset|assets|cut ?outs?|pngs?)", "*", "", "All image assets"),
]
SIZE = rf"{LEFT}(?:fonts?|text){RIGHT}.*{LEFT}(?:over|above|larger than|>)\s*([0-9]+)"


def compile_intents(queries: DataFrame, text: str = "query") -> DataFrame:
    """Adds intent, target (what is searched), arg and sub (what is asked of it) to a table of phrases."""
    q = F.lower(F.trim(text))
    first = F.lit(None).cast("string")
    for c in reversed(COLOR_WORDS):
        first = F.when(q.rlike(word(c)), c).otherwise(first)
    rule = lambda intent, target, arg="", sub="": F.struct(F.lit(intent).alias("intent") if isinstance(intent, str) else intent.alias("intent"), F.lit(target).alias("target"), (F.lit(arg) if isinstance(arg, str) else arg).alias("arg"), F.lit(sub).alias("sub"))
    raised = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 100))
    family = F.when(F.col("_c") == "gray", "grey").otherwise(F.coalesce("_c", F.lit("")))
    kind, size = F.regexp_extract(q, f"{LEFT}({BACKGROUND_KINDS}){RIGHT}", 1), F.regexp_extract(q, SIZE, 1)
    out = F.when(q == "", rule("Type a query", "none"))
    out = out.when(q.rlike(word(COLOR_NOUNS)) | (F.col("_c").isNotNull() & ~q.rlike(word("text"))), rule(F.when(F.col("_c").isNull(), "All colours").otherwise(F.concat(raised(F.col("_c")), F.lit(" colours"))), "color", family))
    out = out.when(q.rlike(word("gradients?")), rule("Gradients", "gradient"))
    out = out.when(q.rlike(word(BACKGROUND_WORDS)), rule(F.when(kind == "", "Background layers").otherwise(F.concat(raised(kind), F.lit(" layers"))), "background", kind))
    for pattern, name, label in TEXT_ROLES:
        found = q.rlike(word(pattern)) | q.contains("call to action") if name == "cta" else q.rlike(word(pattern))
        out = out.when(found, rule(label, "role", name))
    out = out.when(size != "", rule(F.concat(F.lit("Text larger than "), size, F.lit("px")), "size", size))
    out = out.when(q.rlike(word(TEXT_WORDS)), rule("All text layers", "layer", "text"))
    out = out.when(q.rlike(word("layers?")), rule("All layers", "layer", ""))
    for pattern, name, sub, label in OBJECT_WORDS:
        out = out.when(q.rlike(word(pattern)), rule(label, "object", name, sub))
    out = out.otherwise(rule(F.concat(F.lit("Matches for “"), F.trim(text), F.lit("”")), "any", q))
    return queries.withColumn("_c", first).withColumn("_r", out).select("*", "_r.*").drop("_c", "_r")


def percent(x: Column) -> Column:
    return F.concat(half_up(x * 100).cast("string"), F.lit("%"))


def search(intents: DataFrame, texts: DataFrame, objects: DataFrame, palette: DataFrame, backgrounds: DataFrame, gradients: DataFrame, layers: DataFrame, key: str = "pid") -> DataFrame:
    """(qid, key, type, ord, title, subtitle): every intent's hits in every design, one branch per kind of target.

    The table of intents is small by nature (phrases typed by people) and is broadcast: a shuffle on what
    they ask for would send all texts of a role, all boxes of a kind, to one task. Each table is read
    once; its rows meet the intents of all kinds of target that it answers.
    """
    q = F.broadcast(intents.select("qid", "target", "arg", "sub", F.expr("try_cast(arg AS DOUBLE)").alias("least")))
    on = lambda target: F.col("target") == target
    asks = lambda *columns: reduce(or_, (F.lower(c).contains(F.col("arg")) for c in columns))
    hit = lambda df, type, title, sub, n, ord=F.col("ord"): df.select("qid", key, F.lit(type).alias("type"), (F.lit(n) if isinstance(n, int) else n).alias("branch"), ord.alias("ord"), title.alias("title"), sub.alias("subtitle"))
    family = color.family(F.col("h"), F.col("s"), F.col("l"))
    swatches = palette.withColumn("family", family).withColumn("cname", color.name(F.col("h"), F.col("s"), F.col("l")))
    pal_title = F.concat_ws(" ", "cname", "hex")
    # a colour answers to no word, to its family, and yellow and brown to gold
    asked = F.col("arg").isin("", F.col("family")) | ((F.col("arg") == "gold") & F.col("family").isin("yellow", "brown"))
    found = swatches.join(q, (on("color") & asked) | (on("any") & asks("hex", "cname")))
    out = hit(found, "color", pal_title, F.when(on("any"), F.col("role")).otherwise(F.concat_ws(" · ", "role", percent(F.col("weight")))), F.when(on("any"), 2).otherwise(0))
    out = out.unionByName(hit(gradients.join(q, on("gradient") & (F.col("arg") == "")), "color", F.col("css"), F.col("region"), 0))
    out = out.unionByName(hit(backgrounds.join(q, on("background") & F.col("arg").isin("", F.col("kind"))), "background", F.col("label"), F.concat_ws(" · ", "kind", percent(F.col("conf"))), 0))
    px = F.concat(F.floor("size").cast("string"), F.lit("px"))
    found = texts.join(q, (on("role") & (F.col("arg") == F.col("role"))) | (on("size") & (F.col("size") > F.col("least"))) | (on("any") & asks("txt")))
    about = F.when(on("role"), F.concat_ws(" ", "family", F.col("weight").cast("string"), F.lit("·"), px)).when(on("size"), F.concat_ws(" ", px, "family")).otherwise(F.col("role"))
    out = out.unionByName(hit(found, "text", F.col("txt"), about, 0))
    found = layers.join(q, on("layer") & ((F.col("arg") == "") | ((F.col("arg") == "text") & (F.col("type") == "text"))))
    out = out.unionByName(hit(found, "layer", F.col("name"), F.concat_ws(" ", "type", F.lit("layer")), 0, F.when(F.col("arg") == "", -F.col("z")).otherwise(F.col("z"))))
    wanted = on("object") & F.col("arg").isin(F.col("kind"), "*") & ((F.col("sub") == "") | F.expr("lower(label) rlike sub"))
    found = objects.join(q, wanted | (on("any") & asks("label", "kind")))
    return out.unionByName(hit(found, "object", F.col("label"), F.when(on("any"), F.col("kind")).otherwise(F.concat_ws(" · ", "kind", percent(F.col("conf")))), F.when(on("any"), 1).otherwise(0)))
