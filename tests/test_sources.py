"""Files, chunks, questions and streams."""

import re

from pyspark.sql import functions as F

from sparkloom.functions import questions as Q
from sparkloom.operators import chunking
from sparkloom.sources.files import parse_html, read_files
from sparkloom.streaming import jobs


def test_questions(spark):
    q = F.col("q")
    rows = ['What is "reciprocal rank fusion" with nn.Conv2d -deprecated?', "RRF 합성이란 무엇인가", '"rank fusion" nn.Conv2d residual -stale', "ABx residual ab", "the of", "", "-", "compare (a/b) and US, us"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, q string").orderBy("i")
    got = df.select(Q.phrases(q).alias("p"), Q.terms(q).alias("t"), Q.excluded(q).alias("e"), Q.east_asian(q).alias("c"), Q.match_string(q).alias("m"), Q.match_string(q, True).alias("m3"), Q.intent(q).alias("n"), Q.synonyms(q).alias("s")).collect()
    assert (got[0]["p"], got[0]["t"], got[0]["e"], got[0]["c"], got[0]["n"]) == (["reciprocal rank fusion"], ["nn.Conv2d"], ["deprecated"], False, "definition")
    assert got[1]["t"][0] == "RRF" and got[1]["c"] and got[1]["s"] == ["reciprocal rank fusion"]
    assert got[2]["m"] == '"rank fusion" ("nn.Conv2d"* OR residual*) NOT "stale"'
    assert got[3]["m3"] == '("ABx" OR "residual")'
    assert got[4]["m"] == got[5]["m"] == "" and got[6]["t"] == ["-"] * 0 + got[6]["t"]
    assert got[7]["t"] == ["compare", "a/b", "US"] and got[7]["n"] == "comparison"


def test_chunks_cover_the_text_and_stay_small():
    text = " ".join(f"Sentence number {i} says a little more than the one before it did." for i in range(200))
    got = chunking.sentence_windows(text)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(b[0] < a[1] <= b[1] for a, b in zip(got, got[1:]))
    assert all(chunking.estimate(text[a:b]) <= chunking.MOST + chunking.LEAST for a, b in got)
    assert chunking.sentence_windows("") == [] and chunking.sentence_windows("One. Two.") == [(0, 9)]


def test_blocks_stay_whole():
    text = "a" * 90 + "$$" + "x" * 40 + "$$" + "b" * 200 + "\n```\n" + "c" * 150 + "\n```\n" + "d" * 50
    got = chunking.block_windows(text, 100, 10)
    for m in chunking.BLOCK.finditer(text):
        assert any(a <= m.start() and m.end() <= b for a, b in got)
        assert not any(m.start() < p < m.end() for w in got for p in w)
    assert set().union(*(range(a, b) for a, b in got)) == set(range(len(text)))


def test_pages():
    d = parse_html("<title>T  x</title><meta name=author content=Me><nav>no</nav><h1>Head</h1><p>one<p>one<p>t&amp;wo <b>b</b><script>no</script><h2>Sub</h2>")
    assert d == {"title": "T x", "text": "# Head\none\nt&wo b\n## Sub", "author": "Me"}


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_b.md").write_text("---\ntitle: 'Given'\n---\n# Head\nx")
    (tmp_path / "sub" / "c.txt").write_text("\n first line \nrest")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "d.html").write_text("<h1>Page</h1>")
    (tmp_path / "e.exe").write_text("x")
    got = {r["path"].rsplit("/", 1)[-1]: (r["title"], r["error"] is not None) for r in read_files(spark, str(tmp_path)).collect()}
    assert got == {"a_b.md": ("Given", False), "c.txt": ("first line", False), "bad.md": ("bad", True), "d.html": ("Page", False)}


def test_the_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 7).alias("job"), F.col("id").alias("at"), F.when(F.col("id") % 3 == 0, "done").otherwise("running").alias("state"))
    for k in range(3):
        rows.where(f"at % 3 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = jobs.landed(spark, f"{tmp_path}/in/*", rows.schema, 1)
    q = jobs.latest_state(stream, "job", ["at"], "state").writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, jobs.latest_state(rows, "job", ["at"], "state").collect()))
    assert sorted(map(tuple, spark.table("states").collect())) == want
    q = jobs.ingest(jobs.landed(spark, f"{tmp_path}/in/*", rows.schema, 1), f"{tmp_path}/out", f"{tmp_path}/ck", lambda b: b.where("state = 'done'"))
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20 and re.match(r"\d+", str(q.lastProgress["batchId"]))


def test_export_and_import(spark, tmp_path):
    from sparkloom.sources.export import export_tables, read_table

    rows = spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, "ü\n", 9)], "id long, v string, rev long")
    manifest = export_tables({"units": rows, "tombstones": rows.limit(1).select("id")}, f"{tmp_path}/x", {"units": "rev"}, since=7, device="d1")
    assert [tuple(r) for r in manifest.orderBy("place").collect()] == [(0, "tombstones", 1), (1, "units", 2)]
    assert sorted(map(tuple, read_table(spark, f"{tmp_path}/x/device=d1", "units", rows.schema).collect())) == [(2, None, 7), (3, "ü\n", 9)]
