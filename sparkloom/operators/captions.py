"""Numbered objects of books: where they are defined, in which section, and which one a mention means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The words that begin a caption, by kind; what makes a line mathematics; how much farther a definition after the mention counts; the longest line kept.
WORDS = {
    "figure": ["figure", "figures", "fig", "figs"], "table": ["table", "tables", "tbl", "tbls"], "equation": ["equation", "equations", "eq", "eqs", "eqn", "수식"], "section": ["section", "sections"],
    "theorem": ["theorem", "theorems", "lemma", "lemmas", "result", "results", "corollary", "corollaries", "proposition", "propositions", "prop", "definition", "definitions", "claim", "claims", "conjecture", "conjectures"],
}
NUMBER = r"[A-Z]?\d+(?:\.\d+)*"
MATHS = r"[=+\-*/^_{}]|\\[A-Za-z]+|[∑∫√≤≥≈≠]"
AHEAD, LINE, LEVELS = 1.15, 360, 6
CAPTION = rf"(?iu)^\s*({'|'.join(w for words in WORDS.values() for w in words)})\.?\s+({NUMBER}[a-z]?)\b"
LABEL = rf"(?i)(?:^|[\s,;:])\(({NUMBER})\)(?=$|[\s,.;:])"


def lines_of(pages: DataFrame) -> DataFrame:
    """doc_id, page, line (from 0), text and before (the line before, or empty) of pages (doc_id, page, text)."""
    rows = pages.select("doc_id", "page", F.split(F.col("text"), r"\r?\n", -1).alias("_all"))
    rows = rows.select("doc_id", "page", "_all", F.posexplode("_all").alias("line", "text"))
    return rows.select("doc_id", "page", "line", "text", F.when(F.col("line") > 0, F.element_at("_all", F.greatest(F.col("line"), F.lit(1)))).otherwise("").alias("before"))


def captions(lines: DataFrame) -> DataFrame:
    """doc_id, page, line, kind, number and text of the objects that lines define: captions at their beginning, and labels of set-off equations."""
    word = F.lower(F.regexp_extract("text", CAPTION, 1))
    kinds = F.create_map(*[F.lit(x) for kind, words in WORDS.items() for w in words for x in (w, kind)])
    named = F.when(word != "", F.array(F.struct(F.try_element_at(kinds, word).alias("kind"), F.upper(F.regexp_extract("text", CAPTION, 2)).alias("number")))).otherwise(F.array().cast("array<struct<kind:string,number:string>>"))
    bare = F.trim("text")

    def displayed(number: Column) -> Column:
        left = F.trim(F.call_function("substring_index", F.col("text"), F.concat(F.lit("("), number, F.lit(")")), F.lit(1)))
        single = ~F.contains(number, F.lit("."))
        alone = single & (bare == F.concat(F.lit("("), number, F.lit(")"))) & F.col("before").rlike(MATHS)
        return left.rlike(MATHS) | (~single & (left == "")) | alone

    labels = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(LABEL), 1)), displayed)
    labels = F.transform(labels, lambda n: F.struct(F.lit("equation").alias("kind"), F.upper(n).alias("number")))
    found = lines.select("doc_id", "page", "line", "text", F.explode(F.concat(named, labels)).alias("o"))
    return found.select("doc_id", "page", "line", "o.kind", "o.number", F.substring(F.trim("text"), 1, LINE).alias("text"))


def enclosing(lines: DataFrame) -> DataFrame:
    """``lines`` with sections: the headings that enclose each, outermost first, a heading itself among them.

    A stack over the heading levels, as windows: of each level the last heading
    counts if it comes after the last of every higher level.
    """
    mark = F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1))
    title = F.trim(F.regexp_replace("text", r"^#{1,6}\s+", ""))
    at = F.struct("page", "line")
    before = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(mark == k, F.struct(at.alias("at"), title.alias("title")))).over(before) for k in range(1, LEVELS + 1)]
    rows = lines.select("*", *[x.alias(f"_{k}") for k, x in enumerate(last)])
    kept = []
    for k in range(LEVELS):
        higher = [F.col(f"_{i}.at") for i in range(k)]
        newest = F.greatest(*higher) if len(higher) > 1 else higher[0] if higher else F.lit(None)
        kept.append(F.when(F.lit(True) if not higher else newest.isNull() | (F.col(f"_{k}.at") > newest), F.col(f"_{k}.title")))
    return rows.withColumn("sections", F.array_compact(F.array(*kept))).drop(*[f"_{k}" for k in range(LEVELS)])


def resolved(mentions: DataFrame, objects: DataFrame) -> DataFrame:
    """``mentions`` (mention_id, doc_id, kind, number, page) with found_page and found_line of the nearest definition, null if there is none.

    A definition on a later page counts AHEAD times as far; of equally far ones the
    earlier counts, of several on one page the first. No mention meets all
    definitions: the nearest before and after come from windows by kind and number.
    """
    keys = ["doc_id", "kind", "number"]
    there = objects.groupBy(*keys, "page").agg(F.min("line").alias("line")).select(*keys, "page", F.lit(0).alias("asks"), F.struct("page", "line").alias("o"), F.lit(None).cast(dict(mentions.dtypes)["mention_id"]).alias("mention_id"))
    asked = mentions.select(*keys, "page", F.lit(1).alias("asks"), F.lit(None).cast(there.schema["o"].dataType).alias("o"), "mention_id").withColumn("number", F.upper("number"))
    rows = asked.unionByName(there)
    # Before: pages under the mention's; after: its own page and those behind it.
    back = Window.partitionBy(*keys).orderBy("page").rangeBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("page").rangeBetween(0, Window.unboundedFollowing)
    near = rows.select("*", F.max("o").over(back).alias("back"), F.min("o").over(ahead).alias("ahead")).where("asks = 1")
    far = (F.col("ahead.page") - F.col("page")) * F.lit(AHEAD)
    pick = F.when(F.col("back").isNull() | (far < F.col("page") - F.col("back.page")), F.coalesce("ahead", "back")).otherwise(F.col("back"))
    return near.select("mention_id", "doc_id", "kind", "number", "page", pick.alias("p")).select("mention_id", "doc_id", "kind", "number", "page", F.col("p.page").alias("found_page"), F.col("p.line").alias("found_line"))


def owners(objects: DataFrame, outline: DataFrame) -> DataFrame:
    """``objects`` (doc_id, page, line, kind, number) with owner: the outline's title that a numbered object belongs to, null if none does.

    ``outline`` has doc_id, place (its order), title and page. A title with the very
    number counts first, then the nearest one of the chapter on the object's page
    or before, then the most general of the chapter. Appendix 4 also answers to A4.
    """
    heading = rf"(?i)^\s*(appendix\s+)?({NUMBER})"
    number = F.upper(F.regexp_extract("title", heading, 2))
    both = F.when((F.regexp_extract("title", heading, 1) != "") & number.rlike(r"^\d"), F.array(number, F.concat(F.lit("A"), number))).otherwise(F.array(number))
    titles = outline.where(number != "").select("doc_id", "place", "title", "page", F.explode(both).alias("number")).withColumn("chapter", F.substring_index("number", ".", 1))
    exact = titles.groupBy("doc_id", "number").agg(F.min_by("title", "place").alias("exact"))
    parts = F.size(F.split("number", r"\."))
    general = titles.groupBy("doc_id", "chapter").agg(F.min_by("title", F.struct(parts.alias("n"), "place")).alias("general"))
    mine = objects.withColumn("chapter", F.substring_index("number", ".", 1))
    entry = titles.where("page is not null").groupBy("doc_id", "chapter", "page").agg(F.min_by("title", "place").alias("title")).select("doc_id", "chapter", "page", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("number"), "title")
    rows = mine.select("doc_id", "chapter", "page", F.col("line").cast("int").alias("line"), "kind", "number", F.lit(None).cast("string").alias("title")).unionByName(entry)
    upto = Window.partitionBy("doc_id", "chapter").orderBy("page").rangeBetween(Window.unboundedPreceding, 0)
    near = rows.select("*", F.max(F.when(F.col("title").isNotNull(), F.struct("page", "title"))).over(upto).alias("near")).where("number is not null").drop("title")
    out = near.join(exact, ["doc_id", "number"], "left").join(general, ["doc_id", "chapter"], "left")
    return out.select("doc_id", "page", "line", "kind", "number", F.coalesce("exact", "near.title", "general").alias("owner"))
