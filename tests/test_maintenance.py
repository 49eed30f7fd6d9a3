import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.config import Settings
from spindrift.functions import text
from spindrift.jobs import ingest
from spindrift.operators import aggregate, chunking, embed, evaluate, incremental, notes, requests
from spindrift.sources import files, stored
from spindrift.streaming import limits, maintenance


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 40))
def test_recursive_split(content, size):
    overlap = size // 4
    chunks = chunking.split_text(content, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    assert bool(chunks) == bool(content.strip())
    assert set("".join(chunks).split()) >= set() and "".join("".join(chunks).split()).count("a") >= content.count("a")


def test_markdown_sections(spark):
    doc = "intro\n# A\none\ntwo\n## B\n```\n# not a heading\n```\n# C\nlast"
    got = chunking.sections(doc)
    assert got == [([], "intro"), (["A"], "one  \ntwo"), (["A", "B"], "```  \n# not a heading  \n```"), (["C"], "last")]
    rows = spark.createDataFrame([("/n/1.md", "1.md", "mweb", 1.0, 1.0, doc), ("/n/2.md", "2.md", "mweb", 1.0, 1.0, None), ("/n/3.md", "3.md", "mweb", 1.0, 1.0, " ")], "filepath string, filename string, source_type string, mtime double, ctime double, content string")
    made = chunking.chunk_records(rows, markdown=True).collect()
    assert sorted(r.chunk_id.split("_")[1] for r in made if r.filename == "1.md") == ["c0", "c1", "c2", "c3", "fn", "h0"]
    assert [r.chunk_type for r in made if r.filename != "1.md"] == ["filename"] * 2 and len({r.chunk_id for r in made}) == len(made)


def test_long_texts_are_chunked_to_their_end(spark):
    doc = "word " * 6000 + "\n# Late\nlast"
    rows = spark.createDataFrame([("/n/1.md", "1.md", "mweb", 1.0, 1.0, doc)], "filepath string, filename string, source_type string, mtime double, ctime double, content string")
    for markdown in (False, True):
        made = chunking.chunk_records(rows, markdown).collect()
        assert any(r.chunk_type == "content" and r.content.endswith("last") for r in made) and any(r.chunk_type == "heading" and r.title_path == ["Late"] for r in made)
        cut = chunking.chunk_records(rows, markdown, Settings(max_content=20000)).collect()
        assert not any("last" in r.content or "Late" in r.content for r in cut) and len(cut) < len(made)


STATE = "filepath string, mtime double, source_type string"


def test_changes_and_caches(spark):
    inventory = spark.createDataFrame([("a", 1.0, "file"), ("b", 2.0, "file"), ("c", 3.0, "file")], STATE)
    state = spark.createDataFrame([("a", 1.005, "file"), ("b", 2.5, "file"), ("d", 4.0, "mweb")], STATE)
    changed = incremental.changes(inventory, state)
    assert {r.filepath: r.change for r in changed.collect()} == {"a": "unchanged", "b": "modified", "c": "new", "d": "deleted"}
    index = spark.createDataFrame([("a", "old"), ("b", "old"), ("d", "old")], "filepath string, v string")
    fresh = spark.createDataFrame([("b", "new"), ("c", "new"), ("a", "unasked")], "filepath string, v string")
    assert sorted(map(tuple, incremental.apply(index, fresh, changed).collect())) == [("a", "old"), ("b", "new"), ("c", "new")]
    cache = spark.createDataFrame([("a", 1.0, ["x"]), ("b", 2.5, ["y"]), ("c", 3.0, None), ("gone", 1.0, ["z"])], "filepath string, mtime double, chunks array<string>")
    assert {r.filepath: r.hit for r in incremental.cache_lookup(inventory, cache).collect()} == {"a": True, "b": False, "c": False}
    assert {r.filepath for r in incremental.prune(cache, inventory).collect()} == {"a", "b", "c"}
    vectors = spark.createDataFrame([("k", [1.0], 1.0), ("old", [1.0], None)], "text_hash string, vector array<double>, created_at double")
    newer = spark.createDataFrame([("k", [2.0], 5.0)], vectors.schema)
    assert {r.text_hash: r.vector for r in incremental.put(vectors, newer, "text_hash", "created_at").collect()} == {"k": [2.0], "old": [1.0]}
    assert {r.text_hash for r in incremental.expire(vectors, 100 * 86400.0).collect()} == {"old"}
    keys = spark.createDataFrame([("t",)], "text string").select(incremental.embedding_key("model-a", F.col("text")).alias("a"), incremental.embedding_key("model-b", F.col("text")).alias("b")).first()
    assert keys.a != keys.b


def test_inventory_union_reads_all_documents(spark, tmp_path):
    import __spark_entry__ as e

    spark.range(2000).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.filepath: (r.mtime, r.source_type) for r in e.queries()["inventory_union_whole"](spark, str(tmp_path)).collect()}
    assert got == {f"a{i}": (float(i), "file") for i in range(1, 2000, 2)} | {f"{'ba'[i % 2 == 0]}{i}": (i + 0.5, "mweb") for i in range(2000)}


def test_highlight_reaches_the_end_of_texts(spark, tmp_path):
    import __spark_entry__ as e

    spark.createDataFrame([(1, "x " * 5000 + "The end"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.marked for r in e.queries()["highlight_terms_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: "x " * 5000 + "<mark>The</mark> <mark>en</mark>d", 2: None}


def test_fingerprints_hold_no_folder_in_memory(spark):
    import hashlib

    rows = [(f, f"{i}.txt", f"h{i % 7}") for f, n in (("a", 30000), ("b", 3), (None, 5)) for i in range(n)] + [("a", None, "h"), ("c", "x", None)]
    got = notes.fingerprints(spark.createDataFrame(rows, "folder string, name string, content_hash string").repartition(5))
    want = {f: hashlib.sha256("\n".join(sorted(f"{n}:{h}" for g, n, h in rows if g == f and n and h)).encode()).hexdigest() for f in {r[0] for r in rows}}
    made = [tuple(r) for r in got.collect()]
    assert dict(made) == want and len(made) == len(want)
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_inventory_and_formats(spark, tmp_path):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="x"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    xlsx = io.BytesIO()
    with zipfile.ZipFile(xlsx, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="x"><sheets><sheet name="Costs"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>rent</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row><c t="s"><v>0</v></c><c><v>12</v></c></row></sheetData></worksheet>')
    for name, raw in {"a.md": b"# Hi\nthere \xff", "b.tmp": b"x", ".hidden.md": b"x", "c.docx": docx.getvalue(), "d.docx": b"broken", "e.xlsx": xlsx.getvalue(), "f.png": b"\x89PNG"}.items():
        (tmp_path / name).write_bytes(raw)
    found = files.inventory(spark, [str(tmp_path)])
    assert {r.filename for r in found.collect()} == {"a.md", "c.docx", "d.docx", "e.xlsx", "f.png"}
    assert {r.filename for r in files.inventory(spark, [str(tmp_path)], notes=True).collect()} == {"a.md"}
    read = {r.filename: (r.content, r.headings) for r in files.contents(spark, found, [str(tmp_path)]).collect()}
    assert read["a.md"][0] == "# Hi\nthere " and read["c.docx"] == ("Title\nBody text\nk | v", ["Title"]) and read["d.docx"] == ("", []) and read["e.xlsx"] == ("Sheet: Costs\nrent 12", ["Costs"]) and read["f.png"] == ("", [])


def test_qrels(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('# note\n\n{"query": "q", "query_type": "exact", "relevant_files": [{"filepath": "a", "grade": 3}]}\n')
    assert [r.query for r in files.qrels(spark, str(good)).collect()] == ["q"]
    for k, bad in enumerate(('{"query": "q", "relevant_files": [{"filepath": "a", "grade": 0}]}', '{"query": "q", "relevant_files": [{"filepath": "a", "grade": 7}]}', '{"query": "q", "relevant_files": [{"filepath": "a", "grade": 1}, {"filepath": "a", "grade": 2}]}', "broken")):
        path = tmp_path / f"bad{k}.jsonl"
        path.write_text(bad)
        with pytest.raises(Exception, match="not a judged|grade|twice|relevant"):
            files.qrels(spark, str(path)).collect()


def test_categories_and_targets(spark):
    rows = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y")], "uuid string, pid string, name string")
    got = {r.uuid: r.path for r in notes.category_paths(rows).collect()}
    assert got == {"a": "A", "b": "A/B", "c": "A/B/C", "x": "Y/X", "y": "X/Y"}
    deep = [(f"n{i}", f"n{i - 1}" if i else None, f"N{i}") for i in range(150)] + [("l", "l", "Loop"), ("under", "l", "U"), ("orphan", "gone", "O")]
    got = {r.uuid: r.path for r in notes.category_paths(spark.createDataFrame(deep, "uuid string, pid string, name string")).collect()}
    assert got["n149"] == "/".join(f"N{i}" for i in range(150)) and (got["l"], got["under"], got["orphan"]) == ("Loop", "Loop/U", "O") and len(got) == len(deep)
    made = notes.target_paths(spark.createDataFrame([(1, "/o", "T"), (2, "/o", "T"), (3, "/o", "T?")], "id long, folder string, title string"), ["id"])
    assert [r.dest for r in made.orderBy("id").collect()] == ["/o/T.md", "/o/T_1.md", "/o/T_.md"]
    cases = {"---\na: 1\n---\nbody": ("a: 1\n", "body"), "no": (None, "no"), "---\na: 1\nbody": (None, "---\na: 1\nbody"), "---\n---\nx": ("", "x")}
    for raw, want in cases.items():
        x = spark.createDataFrame([(raw,)], "t string").select(notes.split_front_matter(F.col("t")).alias("x")).first().x
        assert (x.meta, x.body) == want


def test_requests(spark):
    rows = spark.createDataFrame([("帮我搜索下黄晓容的信息", "帮我搜索下黄晓容的信息"), ("帮我搜索下黄晓容的信息", "黄晓容"), ("project plan", "project plan"), ("please help me find the budget file please", "please help me find the budget file please")], "u string, q string")
    assert [r.o for r in rows.select(requests.refine(F.col("u"), F.col("q")).alias("o")).collect()] == ["黄晓容", "黄晓容", "project plan", "the budget file"]
    raw = spark.createDataFrame([("web", "when", "0", "x"), ("file", "ctime", "500", "1.5")], "source string, date_field string, limit string, date_from string").withColumn("date_to", F.lit(None).cast("string"))
    assert [tuple(r) for r in requests.clean_request(raw).select("source", "date_field", "limit", "date_from").collect()] == [("all", "mtime", 1, None), ("file", "ctime", 200, 1.5)]
    days = spark.createDataFrame([("2024-02-29",), ("2024-02-30",)], "d string").select(requests.day_bound(F.col("d"), True).alias("e")).collect()
    assert [r.e for r in days] == [1709251199.0, None]


def events(spark):
    pick = random.Random(5)
    rows = [(i, pick.choice("abc"), float(pick.randrange(1000, 2000))) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id long, who string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))


def expected(rows, limit, period):
    out, held = {}, {}
    for i, who, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        own = [x for x in held.get(who, []) if t - x < period]
        out[i] = limit <= 0 or len(own) < limit
        held[who] = [*own, t] if out[i] else own
    return out


@pytest.mark.parametrize("limit", [3, 0])
def test_rate_limit(spark, limit):
    rows, df = events(spark)
    got = {r.id: r.allowed for r in requests.rate_limit(df, ["who"], "ts", limit, 60.0, ["id"]).collect()}
    assert got == expected(rows, limit, 60.0)


def replay(spark, folder, df, files, transform):
    """The rows that a stream gives when the table's files come one by one, and are followed by a row of much later time."""
    for k, part in enumerate(files):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    name = f"replay{abs(hash(str(folder)))}"
    transform(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination(200)
    return spark.table(name).collect()


@pytest.mark.parametrize("batches", [1, 4])
def test_rate_limit_stream_equals_the_batch(spark, tmp_path, batches):
    """Whatever the size of batches; times within the lateness may come in any order, and batches far apart forget nothing."""
    rows, df = events(spark)
    cut = [1000.0 + 1000.0 * k / batches for k in range(batches + 1)]
    late = 20.0
    parts = [df.where((F.col("t") + (F.col("id") % 3) * late / 3 >= low) & (F.col("t") + (F.col("id") % 3) * late / 3 < high)) for low, high in zip(cut, [*cut[1:-1], 1e9], strict=False)]
    end = spark.createDataFrame([(-1, "end", 5000.0)], "id long, who string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = replay(spark, tmp_path, df, [*parts, end], lambda x: limits.limited(x, ["who"], "ts", 3, 60.0, ["id"], "30 seconds"))
    assert {r.id: r.allowed for r in got if r.id >= 0} == expected(rows, 3, 60.0)


def test_expiry_stream_equals_the_filter(spark, tmp_path):
    day = 86400.0
    rows = [(f"k{i}", i * day + 1) for i in range(12)] + [("k3", 11.0 * day + 1), ("none", None)]
    df = spark.createDataFrame(rows, "text_hash string, created_at double")
    end = spark.createDataFrame([("now", 20 * day + 11)], df.schema)
    got = replay(spark, tmp_path, df, [df.where("created_at < 500000"), df.where("created_at >= 500000 OR created_at IS NULL"), end], lambda x: limits.expired(x, "text_hash", "created_at", 14.0))
    last = df.groupBy("text_hash").agg(F.max("created_at").alias("created_at"))
    kept = {r.text_hash for r in incremental.expire(last, 20 * day + 1, 14.0).collect()}
    assert sorted((r.text_hash, r.created_at) for r in got) == sorted((r.text_hash, r.created_at) for r in last.collect() if r.text_hash not in kept)
    assert {r.text_hash for r in got} == {"k0", "k1", "k2", "k4", "k5"}


BUILD = lambda df: df.select("filepath", F.explode(text.words(F.col("content"))).alias("term"))
FILES = "filepath string, mtime double, source_type string, content string"
INVENTORIES = [
    [("a", 1.0, "file", "one two"), ("b", 1.0, "file", "three")],
    [("a", 1.0, "file", "one two"), ("b", 2.0, "file", "four five"), ("c", 1.0, "file", "six")],
    [("a", 3.0, "file", "nine"), ("c", 1.0, "file", "six"), ("d", 1.0, "mweb", "seven")],
]


def follow(spark, folder, parts):
    """Each part is a file of rows (inventory, its size, row) that a run of the stream finds; the index after each run."""
    schema = f"{FILES}, {maintenance.MARKS}"
    out = []
    for rows in parts:
        spark.createDataFrame([(*(row or (None,) * 4), k, n) for k, n, row in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        maintenance.maintain(stream, f"{folder}/index", BUILD, f"{folder}/check", every=None, buckets=8).awaitTermination(120)
        found = maintenance.read_index(spark, f"{folder}/index")
        out.append(None if found is None else sorted(map(tuple, found.collect())))
    return out


def marked(k):
    return [(k + 1, len(INVENTORIES[k]), row) for row in INVENTORIES[k]]


def fresh(spark, k):
    return sorted(map(tuple, BUILD(spark.createDataFrame(INVENTORIES[k], FILES)).collect()))


def test_each_inventory_gives_the_index_of_a_full_build(spark, tmp_path):
    assert follow(spark, tmp_path, [marked(0), marked(1), marked(2)]) == [fresh(spark, k) for k in range(3)]


def test_several_inventories_in_one_trigger(spark, tmp_path):
    """Old and new words of a changed file must not stand side by side, and a deleted file has to go."""
    assert follow(spark, tmp_path, [marked(0) + marked(1) + marked(2)]) == [fresh(spark, 2)]
    state = maintenance.read_state(spark, f"{tmp_path}/index")
    assert sorted((r.filepath, r.mtime) for r in state.collect()) == [("a", 3.0), ("c", 1.0), ("d", 1.0)]


def test_an_inventory_in_several_batches_waits_until_it_is_whole(spark, tmp_path):
    one, two, three = marked(0), marked(1), marked(2)
    parts = [one, two[:1], three[:1] + two[1:2], two[2:], three[1:2] + three[:1], three[2:] + one]
    assert follow(spark, tmp_path, parts) == [fresh(spark, k) for k in (0, 0, 0, 1, 1, 2)]


def test_an_empty_inventory_and_a_late_one(spark, tmp_path):
    got = follow(spark, tmp_path, [marked(0), [(9, 0, None)], marked(1)])
    assert got[0] == fresh(spark, 0) and not got[1] and not got[2]
    assert maintenance.applied(spark, f"{tmp_path}/index") == 9


def test_sweep_keeps_what_versions_need(spark, tmp_path):
    follow(spark, tmp_path, [marked(0), marked(1), marked(2)])
    base = f"{tmp_path}/index"
    held = maintenance.read_index(spark, base, 1).collect()
    assert maintenance.sweep(spark, base, 3600.0) == []
    later = __import__("time").time() + 7200.0
    # A reader of version 1 still finds it while it's young; of old versions the last two stay here.
    assert maintenance.sweep(spark, base, 3600.0, keep=3, now=later) == [f"{base}/arrived/{b}" for b in range(3)] and maintenance.read_index(spark, base, 1).collect() == held
    gone = maintenance.sweep(spark, base, 3600.0, keep=1, now=later)
    assert {f"{base}/versions/1", f"{base}/versions/2"} <= set(gone) and f"{base}/versions/3" not in gone
    assert sorted(map(tuple, maintenance.read_index(spark, base).collect())) == fresh(spark, 2)


def test_only_touched_buckets_are_written(spark, tmp_path):
    build = lambda df: df.select("filepath", F.explode(text.words(F.col("content"))).alias("term"))
    schema = "filepath string, mtime double, source_type string, content string"
    rows = [(f"/f{i}", 1.0, "file", f"word{i}") for i in range(40)]
    base = str(tmp_path / "index")
    first = spark.createDataFrame(rows, schema)
    maintenance.apply_inventory(spark, base, first, build, 1, 8)
    second = spark.createDataFrame([*rows[1:], ("/f1x", 1.0, "file", "more")], schema)
    for _ in range(2):  # the second time it's a repeated batch
        counts = maintenance.apply_inventory(spark, base, second, build, 2, 8).first()
        assert (counts.n_new, counts.n_deleted, counts.n_modified) == (1, 1, 0)
    held = {r.bucket: r.version for r in spark.read.parquet(f"{base}/versions/2").where("bucket >= 0 AND kind = 'index'").collect()}
    assert sorted(held) == list(range(8)) and 1 <= sum(v == 2 for v in held.values()) <= 2
    assert sorted(map(tuple, maintenance.read_index(spark, base).collect())) == sorted(map(tuple, build(second).collect()))
    assert sorted(map(tuple, maintenance.read_index(spark, base, 1).collect())) == sorted(map(tuple, build(first).collect()))
    maintenance.apply_inventory(spark, base, second.limit(0), build, 3, 8)
    assert maintenance.current(spark, base) == 3 and maintenance.read_index(spark, base) is None
    maintenance.apply_inventory(spark, base, first, build, 4, 8)
    assert maintenance.read_index(spark, base).count() == 40


def test_note_heads(spark):
    texts = [
        '---\ntitle: "T"\ncategories:\n  - "a/b"\n  - "c"\nnote_uuid: 7\n---\n\n# H\nbody\n',
        "---\ntags:\n  - x\n---\n## no\n# Yes \nbody",
        "no end\n---",
        "---\nnever closed",
        "",
        None,
    ]
    rows = spark.createDataFrame([(f"/n/{i}.x.md", t) for i, t in enumerate(texts)], "filepath string, content string")
    got = [tuple(r) for r in notes.note_heads(rows).sort("filepath").select("title", "category", "uuid", "body").collect()]
    assert got[0] == ("T", "a/b", "7", "# H\nbody") and got[1] == ("Yes", "", "", "## no\n# Yes \nbody")
    assert [r[0] for r in got[2:]] == ["2.x", "3.x", "4.x", "5.x"] and got[4][3] == got[5][3] == ""


def test_export_plan_and_manifest(spark, tmp_path):
    kind = "uuid string, dest string, content_hash string, media_hash string"
    fresh = spark.createDataFrame([("same", "/a", "1", None), ("moved", "/b", "1", "m"), ("edited", "/c", "2", ""), ("media", "/d", "1", "m2"), ("new", "/e", "1", "")], kind)
    state = spark.createDataFrame([("same", "/a", "1", ""), ("moved", "/old", "1", "m"), ("edited", "/c", "1", ""), ("media", "/d", "1", "m"), ("gone", "/f", "1", None)], kind)
    plan = notes.export_plan(fresh, state)
    got = {r.uuid: (r.action, r.stale) for r in plan.collect()}
    assert got == {"same": ("skip", None), "moved": ("write", "/old"), "edited": ("write", None), "media": ("write", None), "new": ("write", None), "gone": ("remove", "/f")}
    notes.write_manifest(plan, f"{tmp_path}/state")
    after = notes.export_plan(fresh, spark.read.schema(kind).json(f"{tmp_path}/state"))
    assert {r.action for r in after.collect()} == {"skip"}


def test_scan_and_parse_reads_misses_only(spark):
    inventory = spark.createDataFrame([("/a", 1.0), ("/b", 2.0), ("/c", 3.0), ("/none", 4.0)], "filepath string, mtime double")
    contents = spark.createDataFrame([("/a", "new a"), ("/b", "b b"), ("/c", None)], "filepath string, content string")
    cache = spark.createDataFrame([("/a", 1.0, ["old"]), ("/b", 1.0, ["old"]), ("/gone", 1.0, ["old"])], "filepath string, mtime double, chunks array<string>")
    seen = []

    def parse(some):
        seen.extend(r.filepath for r in some.collect())
        return some.select("filepath", F.split("content", " ").alias("chunks"))

    found, kept = ingest.scan_and_parse(inventory, contents, cache, parse)
    assert {r.filepath: (r.chunks, r.hit) for r in found.collect()} == {"/a": (["old"], True), "/b": (["b", "b"], False), "/c": ([], False), "/none": ([], False)}
    assert sorted(seen) == ["/b", "/c"] and sorted(r.filepath for r in kept.collect()) == ["/a", "/b", "/c", "/none"]


def test_embed_once_for_equal_texts(spark):
    texts = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, " "), (4, None), (5, "held"), (6, "x" * 700)], "id int, text string")
    cache = spark.createDataFrame([(row.h, [9.0]) for row in spark.sql("SELECT sha2('m::held', 256) AS h").collect()], "text_hash string, vector array<double>")
    found, fresh = embed.embed(texts, cache, "m")
    got = {r.id: r for r in found.collect()}
    assert got[1].vector == got[2].vector and sum(x * x for x in got[1].vector) == pytest.approx(1) and got[3].vector == got[4].vector == [0.0] * 16
    assert got[5].vector == [9.0] and got[5].hit and not got[1].hit and got[4].text is None and len(got[6].text) == 700
    assert fresh.count() == 3
    again, none = embed.embed(texts, cache.unionByName(fresh), "m")
    assert none.count() == 0 and all(r.hit for r in again.collect())


def test_small_projections(spark):
    lines = "Title\n \t padded \x0b\nends.\nends；\n" + "x" * 79 + "\n" + "y" * 80
    row = spark.createDataFrame([(lines, "e\u0301")], "a string, b string").select(text.page_headings(F.col("a")), text.nfc(F.col("b"))).first()
    assert row[0] == ["Title", "padded", "x" * 79] and row[1] == "é"
    sized = spark.createDataFrame([("s", "x"), ("m", "x" * 201), ("l", "x" * 401), ("s", None)], "k string, t string")
    assert {r.k: (r.batch_size, r.dense_batch_size) for r in evaluate.batch_sizes(sized, "t", ["k"]).collect()} == {"s": (55, 50), "m": (40, 40), "l": (25, 25)}
    assert evaluate.batch_sizes(sized.limit(0), "t", []).first().batch_size == 50
    shown = spark.createDataFrame([("q", i, f"/{i}", None, None, "n", None, "p" * 300) for i in range(1, 13)], "query_id string, rank int, filepath string, score double, mtime double, filename string, relevance string, preview string")
    assert aggregate.listing(shown).where("score = 0 AND mtime = 0 AND snippet = ''").count() == 12
    assert sorted((r["index"], len(r.preview), r.relevance) for r in aggregate.interpretable(shown).collect()) == [(i, 200, "0") for i in range(10)]


def test_benchmark_with_failures(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    results = spark.createDataFrame([("a", 1, "/x"), ("a", 2, "/x"), ("a", 3, "/y"), ("b", 1, "/x")], "query_id string, rank int, filepath string")
    qrels = spark.createDataFrame([("a", "/y", 1), ("b", "/x", 2)], "query_id string, filepath string, grade int")
    runs = spark.createDataFrame([("a", 10.0, True, None), ("b", 20.0, None, True), ("c", None, False, False)], "query_id string, latency_ms double, fallback boolean, failed boolean")
    got = evaluate.benchmark(cases, results, qrels, runs).first()
    assert (got.n_cases, got.mrr_10, got.p50_ms, got.p95_ms) == (3, pytest.approx(0.5 / 3), 15.0, 20.0) and got.rerank_fallback_rate == pytest.approx(1 / 3)
    none = evaluate.benchmark(cases.limit(0), results, qrels, runs.limit(0)).first()
    assert (none.n_cases, none.mrr_10, none.rerank_fallback_rate, none.p50_ms) == (0, 0.0, 0.0, None)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=40))
def test_percentiles_by_running_totals(spark, rows):
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double")
    want = df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p95"), F.count(F.lit(1)).alias("n"))
    order = lambda found: sorted(map(tuple, found.select("k", "p50", "p95", "n").collect()), key=str)
    assert order(evaluate.latency(df, "v", ["k"])) == order(want)


@pytest.mark.parametrize("words, sent", [(1 << 20, 1_000_000), (1, 1_000_000), (1, 0)])
def test_chosen_rows_are_those_of_wanted_keys(spark, monkeypatch, words, sent):
    """Also where nearly all keys share a bit with others, and where these are too many to be sent."""
    monkeypatch.setattr(stored, "WORDS", words)
    monkeypatch.setattr(stored, "SENT_ROWS", sent)
    known = spark.range(500).select(F.concat(F.lit("/f"), "id").alias("filepath"), (F.col("id") % 3 == 0).alias("wanted"))
    rows = spark.range(900).select(F.concat(F.lit("/f"), F.col("id") % 450).alias("filepath"), "id")
    got = stored.chosen(rows, known, "filepath")
    assert got.columns == ["filepath", "id"] and sorted(r.id for r in got.collect()) == [i for i in range(900) if i % 450 % 3 == 0]
    assert stored.chosen(rows, known.withColumn("wanted", F.lit(False)), "filepath").count() == 0


def test_of_repeated_paths_the_latest_row_counts(spark):
    rows = [("a", 1.0, "file", "old"), ("a", 2.0, "file", "new"), ("b", 1.0, "file", "b"), ("c", 1.0, "mweb", "c"), ("c", 1.0, "mweb", "c"), (None, None, None, None)]
    got = maintenance.latest_rows(spark.createDataFrame(rows, FILES)).collect()
    assert sorted(map(tuple, got)) == [("a", 2.0, "file", "new"), ("b", 1.0, "file", "b"), ("c", 1.0, "mweb", "c")]


def stages(spark):
    """What the session's stages have done so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def shuffled(spark):
    return sum(s.shuffleWriteBytes() for s in stages(spark))


def test_rows_of_a_partitioned_table_are_not_sorted(spark, tmp_path):
    with stored.open_files(spark, 4):
        spark.range(0, 100_000, 1, 1).withColumn("bucket", F.col("id") % 4).write.partitionBy("bucket").parquet(f"{tmp_path}/t")
    assert max(stages(spark), key=lambda s: s.stageId()).peakExecutionMemory() == 0 and spark.read.parquet(f"{tmp_path}/t").where("bucket = 3").count() == 25_000
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_neither_texts_nor_rows_of_the_index_are_shuffled(spark, tmp_path):
    pick = random.Random(3)
    rows = [(f"/f{i}", 1.0, "file", " ".join(f"{pick.randrange(1 << 40):x}" for _ in range(3000))) for i in range(60)]
    later = [(p, m + (i % 3 == 0), t, c) for i, (p, m, t, c) in enumerate(rows[5:])]
    before = shuffled(spark)
    got = follow(spark, tmp_path, [[(1, 60, r) for r in rows], [(2, 55, r) for r in later]])
    assert [len(x) for x in got] == [180_000, 165_000] and got[1] == sorted(map(tuple, BUILD(spark.createDataFrame(later, FILES)).collect()))
    assert shuffled(spark) - before < 200_000  # texts have 2,000,000 bytes
