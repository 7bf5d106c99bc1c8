"""Operators on inline rows: edge cases that the derived tables don't have."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire import fixtures
from quire.functions import boxes, images, markup, text
from quire.operators import assembly, evals, extraction, index, layout, packets, parse, runs
from quire.plans import jobs
from quire.sources import storage
from quire.streaming import jobs as streams

BOX = "struct<x:double,y:double,w:double,h:double,coord_space:string>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit_box(x, y, w, h):
    return boxes.box(*map(F.lit, map(float, (x, y, w, h))))


def block_rows(spark, rows):
    """(run, page, ord, type, text, (x, y, w, h)) as block rows."""
    out = [
        ("w", run, run, page, n, f"b{n}", kind, (float(b[0]), float(b[1]), float(b[2]), float(b[3]), "page_norm"), body, f"<p>{body}</p>", [], [(page, body, [])])
        for run, page, n, kind, body, b in rows
    ]
    schema = f"workspace_id string, document_id string, parse_run_id string, page int, ord int, block_id string, type string, bbox {BOX}, text string, html string, children array<string>, citations array<struct<page:int,matching_text:string,bboxes:array<{BOX}>>>"
    return spark.createDataFrame(out, schema)


def test_boxes(spark):
    assert one(spark, boxes.iou(lit_box(0, 0, 0.5, 0.5), lit_box(0.25, 0.25, 0.5, 0.5))) == pytest.approx(0.0625 / 0.4375)
    assert one(spark, boxes.iou(lit_box(0, 0, 0, 0), lit_box(0, 0, 0, 0))) == 0
    b = one(spark, boxes.from_edges(*map(F.lit, (-5.0, 10.0, -9.0, 900.0, 100.0, 100.0))))
    assert (b.x, b.y, b.w, b.h) == (0.0, 0.1, 1e-6, 1.0)
    assert one(spark, boxes.detector_box(*map(F.lit, (20.0, 0.0, 10.0, 5.0, 100.0, 100.0)))) is None
    assert one(spark, boxes.detector_box(*map(F.lit, (0.1, 0.1, 1.2, 0.5, 100.0, 100.0)))).w == pytest.approx(0.9)
    none = F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>")
    some = F.array(F.struct(*[F.lit(v).alias(k) for k, v in (("x1", 0), ("y1", 0), ("x2", 4), ("y2", 4))]))
    assert [one(spark, boxes.set_iou(a, b)) for a, b in ((none, none), (none, some), (some, some))] == [1.0, 0.0, 1.0]


def test_region_rules(spark):
    kind = lambda t, size=11.0, y=0.1: one(spark, text.region_type(F.lit(t), F.lit(size), F.lit(y)))
    assert [kind("x", y=0.93), kind("Chapter 1"), kind("x", 16.0), kind("a | b"), kind("the total is"), kind("e = mc"), kind("plain")] == [
        "footer", "header", "header", "table", "table", "equation", "paragraph",
    ]
    assert [one(spark, text.segment_label(F.lit(t))) for t in ("Bill To: x", "WHEREAS the", "zzz")] == ["invoice", "contract", "document"]
    assert one(spark, text.anchor(F.lit("it's"), lit_box(0.1, 0.2, 0.3, 0.4))) == "Native text at bbox [0.100000,0.200000,0.300000,0.400000]: 'it\\'s'"
    assert [one(spark, text.character_error_rate(F.lit(a), F.lit(b))) for a, b in (("", ""), ("a", ""), ("", "a"), ("abcd", "abed"), ("a", "xyzw"))] == [0, 1, 1, 0.25, 1]
    assert one(spark, text.semantic_gap(F.lit("word,  "), F.lit(" élan"))) == 0.0 and one(spark, text.semantic_gap(F.lit("word."), F.lit("x"))) == 0.2


def test_grouping_fold(spark):
    spans = [("r", 0, i, "t", (0.1, 0.1 + 0.05 * i, 0.2, 0.03)) for i in range(3)] + [("r", 0, 9, "u", (0.1, 0.6, 0.2, 0.03)), ("r", 2, 0, "p", (0.1, 0.1, 0.2, 0.02))]
    df = spark.createDataFrame(
        [("w", r, r, p, o, t, (*b, "page_norm"), 11.0) for r, p, o, t, b in spans],
        f"workspace_id string, document_id string, parse_run_id string, page int, ord int, text string, bbox {BOX}, size double",
    )
    got = {(r.page, r.ord): r.region for r in layout.group_spans(df.repartition(3)).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (0, 9): 1, (2, 0): 0}
    found = parse.blocks(layout.regions(layout.group_spans(df))).orderBy("page", "ord").collect()
    assert [(r.text, r.engine, round(r.confidence.calibrated, 4)) for r in found] == [("t t t", "native_pdf_anchor", 0.94), ("u", "native_pdf_anchor", 0.94), ("p", "native_pdf_anchor", 0.94)]


def brute_order(rows):
    """Reading order of one run of (page, ord, text, (x, y, w, h)) in input order, by the stated rules."""
    col = lambda b: int(b[0] + b[2] / 2 > 0.62)
    centre = lambda b: ((2 * b[0] + b[2]) / 2, (2 * b[1] + b[3]) / 2)
    n = len(rows)
    hint = sorted(range(n), key=lambda i: (rows[i][0], col(rows[i][3]), rows[i][3][1], rows[i][3][0]))
    rank = {i: k for k, i in enumerate(hint)}

    def after(i, j):
        (p, _, _, a), (q, _, _, b) = rows[i], rows[j]
        if p != q:
            return q > p
        if col(a) != col(b):
            return col(b) > col(a) and b[1] >= a[1] - 0.08
        return b[1] > a[1] or (abs(b[1] - a[1]) < 0.02 and b[0] > a[0])

    def cost(i, j):
        a, b, s, t = rows[i][3], rows[j][3], rows[i][2], rows[j][2]
        gap = 0.0 if s.rstrip().endswith(("-", ",", ";")) and t.lstrip()[:1].islower() else 0.2
        return 0.4 * min(1.0, math.dist(centre(a), centre(b))) + 0.3 * gap + 0.3 * (0.8 if col(a) != col(b) else 0.0)

    follow = {}
    for i in range(n):
        others = [j for j in range(n) if j != i and after(i, j)]
        if others:
            follow[i] = min(others, key=lambda j: round(cost(i, j), 12))
    degree = [sum(f == j for f in follow.values()) for j in range(n)]
    ready, out = [i for i in range(n) if not degree[i]], []
    while ready:
        i = min(ready, key=rank.get)
        ready.remove(i)
        out.append(i)
        if i in follow:
            degree[follow[i]] -= 1
            if not degree[follow[i]]:
                ready.append(follow[i])
    return out if len(out) == n else hint


def test_reading_order_against_brute_force(spark):
    r = random.Random(3)
    by_run, rows = {}, []
    for run in range(12):
        made = [(r.randrange(3), k, r.choice(["end,", "low word", "Upper.", "half-"]), (r.choice([0.05, 0.1, 0.6]), round(r.random(), 3), 0.3, 0.02)) for k in range(r.randrange(1, 14))]
        made.sort(key=lambda x: (x[0], x[1]))
        by_run[str(run)] = [f"b{made[i][1]}" for i in brute_order(made)]
        rows += [(str(run), p, k, "paragraph", t, b) for p, k, t, b in made]
    rows += [("cycle", 0, 0, "paragraph", "a", (0.5, 0.1, 0.1, 0.02)), ("cycle", 0, 1, "paragraph", "b", (0.1, 0.11, 0.1, 0.02))]
    by_run["cycle"] = ["b0", "b1"]
    got = {}
    for x in assembly.reading_order(block_rows(spark, rows).repartition(5)).orderBy("parse_run_id", "rank").collect():
        got.setdefault(x.parse_run_id, []).append(x.block_id)
    assert got == by_run
    small = block_rows(spark, [x for x in rows if x[0] == "3"])
    assert assembly.successors(small).count() <= len(by_run["3"])


def test_merge_and_stitch(spark):
    rows = [("r", 0, k, "paragraph", t, (0.1, 0.1 * k, 0.3, 0.02)) for k, t in enumerate(["one exam-", "ple two,", "three,", "four <b>", "Five"])]
    ranked = block_rows(spark, rows).withColumn("rank", F.col("ord"))
    got = [(x.text, x.children) for x in assembly.merge_paragraphs(ranked).orderBy("rank").collect()]
    assert got == [("one exam ple two,", ["b1"]), ("three, four <b>", ["b3"]), ("Five", [])]
    tables = [("t", p, p, "table", "head\nrow", (0.1, 0.1, 0.5, 0.2)) for p in range(3)]
    ranked = block_rows(spark, tables).withColumn("rank", F.col("ord"))
    assert [x.children for x in assembly.stitch_tables(ranked).orderBy("rank").collect()] == [["b1"], []]
    assert [x.children for x in assembly.stitch_tables(ranked, chain=True).collect()] == [["b1", "b2"]]


def test_reference_numbers(spark):
    side = lambda x, y, t, c: F.struct(lit_box(x, y, 0.2, 0.05).alias("bbox"), F.lit(t).alias("text"), F.lit(c).alias("col"))
    assert one(spark, assembly.edge_weight(side(0.1, 0.1, "Hello,", 0), side(0.1, 0.2, "world.", 0))) < 0.3
    assert one(spark, assembly.edge_weight(side(0.1, 0.1, "Hello.", 0), side(0.7, 0.1, "World.", 1))) >= 0.5
    widths = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, assembly.stitch_score(F.lit("A | B"), F.lit(" A | B"), widths(0.2, 0.6, 0.2), widths(0.2, 0.59, 0.21), F.lit(0.9), F.lit(True))) > 0.9
    assert one(spark, index.hybrid(*map(F.lit, (1.0, 0.5, 1.0, 0.0, 0.5)))) == pytest.approx(0.75)
    assert one(spark, index.sign_quantised(widths(-0.1, 0.0, 0.3))) == [-1, 1, 1]
    ranks = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "b", 1), (1, 2, "c", 2)], "query_id int, ranking_id int, doc_id string, rank int")
    fused = {r.doc_id: r.score for r in index.reciprocal_rank_fusion(ranks).collect()}
    assert fused["b"] > fused["a"] and fused["b"] > fused["c"]
    q = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]])], "query_id long, tokens array<array<double>>")
    d = spark.createDataFrame([(7, [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]), (8, [])], "point_id long, patches array<array<double>>")
    assert [(r.point_id, r.score) for r in index.max_sim(d, q).collect()] == [(7, 2.0)]
    name = "123e4567-e89b-12d3-a456-426614174000:3"
    assert one(spark, index.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.UUID(index.POINT_NAMESPACE), name))


def test_calibration(spark):
    rows = spark.createDataFrame([(0.05, 0), (0.2, 0), (0.45, 0), (0.7, 1), (0.92, 1)], "score double, truth int")
    fitted = evals.calibrated(rows, evals.fit_calibrator(rows)).select(F.col("calibrated").alias("score"), "truth")
    assert evals.calibration_error(fitted).first().ece < 0.05
    edge = spark.createDataFrame([(0.3, 1), (1.0, 1)], "score double, truth int")
    assert evals.calibration_error(edge).first().ece == pytest.approx(0.35)
    assert evals.calibration_error(edge.limit(0)).first().n_rows == 0


def test_extraction(spark):
    blocks = block_rows(spark, [("r", 0, 0, "paragraph", "Vendor: Acme Corp  Total Amount Due: $4,250.00", (0, 0, 1, 1)), ("r", 0, 1, "paragraph", "nothing", (0, 0, 1, 1)), ("q", 0, 0, "paragraph", "zzz", (0, 0, 1, 1))])
    blocks = blocks.withColumn("schema_id", F.lit(1)).withColumn("confidence", F.struct(F.lit(0.9).alias("calibrated")))
    schema = '{"properties": {"vendor": {"type": "string"}, "total_amount": {"type": "number", "pattern": "due: \\\\$([\\\\d,.]+)", "minimum": 1, "maximum": 99}, "paid": {"type": "boolean"}}, "required": ["vendor"]}'
    fields = extraction.schema_fields(spark.createDataFrame([(1, schema)], "schema_id int, json_schema string"))
    got = {(r.parse_run_id, r.field_name): r for r in extraction.extract(blocks, fields).collect()}
    assert got["r", "vendor"].value == "Acme" and got["r", "total_amount"].typed.number == 4250.0
    assert [(v.name, v.status) for v in got["r", "total_amount"].validators] == [("regex", "fail"), ("minimum", "pass"), ("maximum", "fail")]
    assert got["q", "vendor"].value == "zzz" and got["q", "paid"].typed.boolean is False
    assert got["r", "vendor"].raw_confidence == pytest.approx(1 / (1 + math.exp(-(0.25 + 0.3 + 0.18 + 0.1125))))
    assert one(spark, text.trimmed_label(F.lit("Acme  Due Date: 1"))) == "Acme"
    none = spark.createDataFrame([("total", []), ("_private", [])], "field_name string, citations array<string>")
    assert [r.field_name for r in extraction.without_citations(none).collect()] == ["total"]
    over = extraction.overlaid(
        spark.createDataFrame([("r", "a", "x"), ("r", "b", "y")], "parse_run_id string, field_name string, value string"),
        spark.createDataFrame([("r", "a", None, True), ("r", "b", "z", False)], "parse_run_id string, field_name string, value string, present boolean"),
    )
    assert {r.field_name: r.value for r in over.collect()} == {"a": None, "b": "y"}


def packet(spark, pages, kind="paragraph"):
    rows = [("p", n, 0, k if isinstance(k, str) and k in ("header",) else kind, n, t) for n, k, t in pages]
    return spark.createDataFrame(rows, "parse_run_id string, page int, ord int, type string, reading_order_rank int, text string")


def test_split_and_classify(spark):
    pages = [(0, "", "invoice bill to acme amount due"), (1, "", "invoice bill to acme payment due"), (3, "", "agreement whereas party confidential"), (4, "header", "agreement whereas party schedule")]
    got = jobs.split_packets(packet(spark, pages)).orderBy("start_page").collect()
    assert [(r.start_page, r.end_page, r.label) for r in got][:2] == [(0, 2, "invoice"), (3, 3 if len(got) > 2 else 4, "contract")]
    assert jobs.split_packets(packet(spark, pages), min_pages=9).count() == 1
    assert jobs.split_packets(packet(spark, [(2, "", "one page")])).first().confidence == 0.8
    assert jobs.split_packets(packet(spark, [(2, "", "  ")])).first().evidence == "no parse blocks"
    cats = spark.createDataFrame([(0, "invoice", "bill amount due payment"), (1, "  ", "blank"), (2, "contract", "agreement party")], "ord int, label string, description string")
    done = {r.page: r for r in jobs.classify_pages(packet(spark, [*pages, (7, "", "qqq www")]), cats).collect()}
    assert done[0].label == "invoice" and done[0].confidence > 0.25 and done[3].label == "contract" and done[7].label == "uncertain"
    assert packets.run_level(jobs.classify_pages(packet(spark, pages), cats)).first().page_labels[0] == "invoice"


def test_markup_and_images(spark):
    md = "Intro & co\n| a | b |\n|---|:-:|\n| 1 | <2> |\nend\n\n| solo |"
    want = "<p>Intro &amp; co</p>\n<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>&lt;2&gt;</td></tr></table>\n<p>end</p>\n<table><tr><th>solo</th></tr></table>"
    assert one(spark, markup.markdown_to_html(F.lit(md))) == want
    assert one(spark, markup.html_text(F.lit("<p> a  b</p><script>x</script>"), ("script",))) == "a b"
    assert one(spark, markup.html_text(F.lit("<br>"))) == "" and one(spark, markup.html_text(F.lit(None).cast("string"))) is None
    raw = '<!-- c > d --><p title="a>b">x &lt; &amp;amp; y</p>a < b<br/>\xa0c<script>var t = "</p>";</script>d'
    assert one(spark, markup.html_text(F.lit(raw))) == 'x < &amp; y a < b c var t = "</p>"; d'
    assert one(spark, markup.html_text(F.lit(raw), ("script", "style"))) == "x < &amp; y a < b c d"
    assert one(spark, markup.html_text(F.lit("<script>x</script>"), ("script",))) == "x"
    assert one(spark, markup.html_text(F.lit("<p>a &amp</p>&amp;lt; &nope; &#65; &ampx;"))) == "a & &lt; &nope; A &x;"
    assert one(spark, markup.html_text(F.lit("<p>a &amp</p>&amp;lt; &nope; &#65; &ampx;"), closed=True)) == "a &amp &lt; &nope; A &ampx;"
    assert one(spark, markup.one_row_table(F.lit("  "))) == "<table></table>"
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (20, 30, 3)).astype(float)
    assert images.structural_similarity(a, a) == pytest.approx(1.0) and images.structural_similarity(a, 255 - a) < 0.5
    assert images.structural_similarity(a, a[:10]) == 0.0
    white = np.full((10, 10, 3), 255, np.uint8)
    dark = white.copy()
    dark[4, 5] = 0
    rows = spark.createDataFrame([(10, 10, 3, bytearray(white.tobytes())), (10, 10, 3, bytearray(dark.tobytes()))], "height int, width int, nChannels int, data binary")
    b = [r.b for r in rows.select(images.foreground_box(*map(F.col, rows.columns)).alias("b")).collect()]
    assert b[0] is None or b[0].x is None
    assert (b[1].x, b[1].y, b[1].w, b[1].h) == (0.1, 0.0, 0.9, 0.9)


def test_verify(spark):
    rows = [(1.0, None, 1.0, None, False), (0.5, 0.5, 0.5, 0.5, False), (1.0, 0.0, 1.0, 1.0, True)]
    got = [r.verifier for r in parse.verified(spark.createDataFrame(rows, "ssim double, cer double, layout_iou double, clip_sim double, is_degraded boolean")).collect()]
    assert [(v.score, v.flag_for_repair, v.component_missing) for v in got] == [(1.0, False, True), (0.5, True, False), (0.5, True, False)]


def test_streams_equal_batches(spark, tmp_path):
    rows = [Row(doc_id=i, text=f"line {i}\nsecond") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    job = lambda d: d.select("doc_id", F.length("text").alias("n"))
    for _ in range(2):
        source = streams.document_stream(spark, f"{tmp_path}/in", df.schema, 1)
        streams.incremental(source, job, f"{tmp_path}/out", f"{tmp_path}/ck", "doc_id").awaitTermination()
    assert sorted(map(tuple, storage.read_collection(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, job(df).collect()))
    events = spark.createDataFrame([("r", "succeeded", 1, 1), ("r", "running", 2, 2), ("q", "queued", 1, 3)], "parse_run_id string, state string, ts int, event_id int")
    assert {r.parse_run_id: r.state for r in runs.latest_state(events).collect()} == {"r": "succeeded", "q": "queued"}
    good, bad = streams.with_dead_letters(df, F.when(F.col("doc_id") == 3, F.repeat(F.lit("x"), F.lit(5000))))
    assert good.count() == 19 and len(bad.first().error) == 4000


def test_collections(spark, tmp_path):
    path, points = str(tmp_path / "c"), lambda rows: spark.createDataFrame(rows, "point_id long, v string, at int")
    state = lambda: {r.point_id: r.v for r in storage.read_collection(spark, path).collect()}
    with pytest.raises(FileNotFoundError):
        storage.read_collection(spark, path)
    storage.upsert_collection(spark, points([(1, "a", 1), (2, "b", 1), (2, "c", 3), (2, "d", 2)]), path, order="at")
    assert state() == {1: "a", 2: "c"}
    storage.upsert_collection(spark, points([(2, "e", 1), (3, "f", 1)]), path, order="at")
    storage.upsert_collection(spark, points([]), path)
    assert state() == {1: "a", 2: "e", 3: "f"}
    points([(9, "lost", 0)]).withColumn("__bucket", F.lit(0)).write.partitionBy("__bucket").parquet(f"{path}/v=000000099")
    (tmp_path / "c" / "v=000000099" / "_SUCCESS").unlink()  # a writer that crashed
    assert state() == {1: "a", 2: "e", 3: "f"}
    storage.rebuild_collection(points([(7, "g", 1)]), path)
    assert state() == {7: "g"}


def test_rows_of_runs_without_blocks(spark):
    fields = extraction.schema_fields(spark.createDataFrame([(0, '{"properties": {"n": {"type": "number"}, "_l": {"type": "array"}, "b": {"type": "boolean"}, "s": {"type": "string"}}}')], "schema_id int, json_schema string"))
    box = "struct<x:double,y:double,w:double,h:double,coord_space:string>"
    blocks = spark.createDataFrame([("r1", 0, 0, 0, "b", "n: 3", None, None)], f"parse_run_id string, schema_id int, page int, ord int, block_id string, text string, bbox {box}, confidence struct<raw:double,calibrated:double>")
    runs_ = spark.createDataFrame([("r1", 0), ("r2", 0)], "parse_run_id string, schema_id int")
    found, rejected = jobs.extract_fields(blocks, fields, runs_)
    empty = {r.field_name: r for r in found.filter("parse_run_id = 'r2'").collect()}
    assert (empty["n"].typed.number, empty["b"].typed.boolean, empty["_l"].typed.array, empty["s"].typed.string) == (0.0, False, [], "")
    assert all(r.citations == [] and r.raw_confidence == 0.0 and r.validators[0].status == "fail" for r in empty.values()) and len(empty) == 4
    assert sorted(r.field_name for r in rejected.collect()) == ["b", "n", "s"]


def test_storage(spark, tmp_path):
    lines = spark.createDataFrame([('stage=a event=b c run=7 error={"k": 1, "x": 2}',)], "line string")
    got = storage.parsed_log(lines).first()
    assert (got.stage, got.event, got.run, got.error, got.ms) == ("a", "b c", "7", '{"k": 1, "x": 2}', None)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.pdf").write_bytes(b"abc")
    row = storage.raw_files(spark, str(tmp_path / "f"), "w").first()
    assert (row.filename, row.byte_size) == ("a.pdf", 3) and row.file_hash_sha256.startswith("ba7816bf")
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "invoice.expected.json").write_text('{"doc_type": "invoice",\n "page_count": 1, "extraction": {"total": 4250.0}}')
    case = storage.golden_cases(spark, str(tmp_path / "g")).first()
    assert (case.case, case.doc_type) == ("invoice", "invoice")


def test_table_scores_make_a_text_once(spark):
    rows = spark.createDataFrame([("a-b 12.50 qty", "<td>ab</td><td>12.50</td><td>none</td><td>x</td>"), ("a", "<td></td>"), (None, "ab"), ("ab", None)], "text string, expected string")
    done = rows.select(evals.table_score(F.col("text"), F.col("expected")).alias("v"))
    assert [round(r.v, 6) for r in done.collect()] == [round(2 / 3, 6), 0.0, 0.0, 0.0]
    assert "contains(regexp_replace" not in done._jdf.queryExecution().analyzed().toString().lower()


def test_blocks_make_no_html_that_is_not_read(spark):
    spans = fixtures.spans_of(spark.createDataFrame([(1, "Chapter | one\na < b total c\n x ")], "doc_id long, text string"))
    blocks = jobs.corpus_blocks(spans)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "<td>" in plan(blocks.select("html")) and "<td>" not in plan(blocks.select("confidence.calibrated", "engine", "needs_review"))
    signs = [chr(c) for c in range(1, 0x3100)]
    rows = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in signs], "t string")
    assert rows.filter(~text.stripped(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_terms_are_not_shuffled(spark):
    rows = [("a", 0, "red blue green"), ("a", 1, "red red stone"), ("a", 3, "blue stone"), ("b", 5, "red"), ("c", 1, "of the"), ("c", 2, "sea")]
    pages = spark.createDataFrame(rows, "parse_run_id string, page int, text string")
    like = packets.adjacent_similarity(pages, packets.term_weights(pages))
    scores = packets.lexical_scores(pages, [("red", "red things"), ("sea", "")])
    for df in (like, scores):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in line and "term#" in line for line in plan.split("\n"))
    found = {(r.parse_run_id, r.page): (r.before, r.similarity) for r in like.collect()}
    assert set(found) == {("a", 1), ("a", 3), ("c", 2)} and found["a", 3][0] == 1 and found["c", 2] == (1, 0.0) and 0 < found["a", 1][1] < 1
    assert scores.count() == 2 * len(rows)
