"""Anchors, alignment, rows of tokens, ranges, graphs, files in ranges, projections, releases and publication on small cases."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from trivalent.operators import anchoring, intervals, links, ocr_rows, projection, publication, release, source_graph
from trivalent.sources.pieces import numbered_lines, passed, statements

NODES = [("d", p, n, f"s{n}", line) for n, (p, line) in enumerate([(1, "one"), (1, " two  "), (1, "three"), (2, "one"), (2, "كتاب ۱۲"), (2, ""), (3, "last"), (3, "one")])]


def anchored(spark, records):
    nodes = spark.createDataFrame(NODES, "document string, page long, place long, span string, line string")
    rows = spark.createDataFrame([("d", i, *r) for i, r in enumerate(records)], "document string, record long, pages array<long>, text string, spans array<string>")
    return {r.record: (r.status, r.reason, r.matches, r.spans) for r in anchoring.record_anchors(rows, nodes).collect()}


def test_anchors(spark):
    got = anchored(spark, [
        ([1], "two\n\nthree", None), ([1, 2], "three\none", []), ([1, 3], "one", None), ([2], "کتاب ۱۲", None), ([3], "one\nlast", None), ([1], "  ", None), ([1], None, None),
        ([9], "one", None), ([None], "one", None), (None, "one", None), ([1, 3], "three\nlast", None), ([2, 3], "کتاب ۱۲\nlast", None),
        ([1], "one\ntwo", ["s0", "s1"]), ([1], "one\ntwo", ["s1", "s0"]), ([1], "one", ["s3"]), ([1], "one\nthree", ["s0", "s2"]), ([1], "one", [None]), ([2], "one\nکتاب ۱۲", ["s3", "s4", "s5"]), ([1], "one\r\ntwo three", None),
    ])
    want = {
        0: ("anchored", None, 1, ["s1", "s2"]), 1: ("anchored", None, 1, ["s2", "s3"]), 2: ("ambiguous", "multiple_exact_matches", 2, None), 3: ("anchored", None, 1, ["s4"]), 4: ("unmatched", "no_exact_contiguous_match", 0, None), 5: ("unmatched", "missing_text", 0, None), 6: ("unmatched", "missing_text", 0, None),
        7: ("unmatched", "unknown_source_page", 0, None), 8: ("unmatched", "invalid_source_page_ids", 0, None), 9: ("unmatched", "invalid_source_page_ids", 0, None), 10: ("anchored", None, 1, ["s2", "s6"]), 11: ("unmatched", "no_exact_contiguous_match", 0, None),
        12: ("already_anchored", None, 0, ["s0", "s1"]), 13: ("invalid_existing_anchor", "existing_spans_do_not_match_record_text", 0, None), 14: ("invalid_existing_anchor", "span_not_on_source_page", 0, None), 15: ("invalid_existing_anchor", "existing_spans_do_not_match_record_text", 0, None),
        16: ("invalid_existing_anchor", "invalid_source_span_ids", 0, None), 17: ("already_anchored", None, 0, ["s3", "s4", "s5"]), 18: ("anchored", None, 1, ["s0", "s1", "s2"]),
    }
    assert got == want
    assert anchored(spark, [([1], "one", None)] * 2) == {0: ("anchored", None, 1, ["s0"]), 1: ("anchored", None, 1, ["s0"])}


def test_long_runs_anchor(spark):
    """Runs of more lines than a hash has bits, with lines that repeat at its period, are told apart."""
    lines = [f"l{i % 64}" if i < 192 else f"m{i}" for i in range(300)]
    nodes = spark.createDataFrame([("d", 1, i, f"s{i}", line) for i, line in enumerate(lines)], "document string, page long, place long, span string, line string")
    texts = ["\n".join(lines[a:b]) for a, b in ((0, 64), (1, 130), (100, 260), (0, 300))] + ["\n".join([*lines[64:128], *lines[0:1], "m192"])]
    rows = spark.createDataFrame([("d", i, [1], t, None) for i, t in enumerate(texts)], "document string, record long, pages array<long>, text string, spans array<string>")
    got = {r.record: (r.status, r.matches) for r in anchoring.record_anchors(rows, nodes).collect()}
    plain = {i: sum(lines[s : s + len(t.split("\n"))] == t.split("\n") for s in range(len(lines))) for i, t in enumerate(texts)}
    assert got == {i: ("anchored" if n == 1 else "ambiguous" if n else "unmatched", n) for i, n in plain.items()}


def test_alignment_is_greedy(spark):
    """The first line takes the last alternate one, so that three links are lost which a longest common subsequence has."""
    canonical = spark.createDataFrame([("k", i, t) for i, t in enumerate(["z", "a", "b", "c", "a"])] + [("none", 0, "a")], "k string, at long, line string")
    other = spark.createDataFrame([("k", i, t) for i, t in enumerate(["a", "b", "c", "z", "a", "a"])] + [("more", 0, "a")], "k string, at long, line string")
    got = {(r.k, r["at"]): r.other for r in anchoring.greedy_alignment(canonical, other, "k", "at", "line").collect()}
    assert got == {("k", 0): 3, ("k", 1): 4, ("k", 2): None, ("k", 3): None, ("k", 4): 5, ("none", 0): None}


def plain_rows(tokens):
    """tokens of a page: (place, text, left, top, right, bottom)."""
    groups = []
    for t in sorted(tokens, key=lambda t: (t[3], t[2], t[0])):
        centre, height = (t[3] + t[5]) / 2, max(1, t[5] - t[3])
        for g in reversed(groups[-3:]):
            mean = sum((x[3] + x[5]) / 2 for x in g) / len(g)
            if abs(centre - mean) <= max(height, 1, max(x[5] for x in g) - min(x[3] for x in g)) * 0.6:
                g.append(t)
                break
        else:
            groups.append([t])
    return [" ".join(x[1] for x in sorted(g, key=lambda x: -x[2])) for g in groups]


def test_rows_of_tokens(spark):
    rng = random.Random(7)
    pages = {f"p{n}": [(i, f"w{i}", rng.randint(0, 300), (y := rng.randint(0, 120)), 310, y + rng.randint(0, 30)) for i in range(rng.randint(1, 60))] for n in range(12)}
    pages["back"] = [(0, "a", 0, 0, 9, 2), (1, "b", 0, 10, 9, 11), (2, "c", 0, 20, 9, 21), (3, "back", 5, 21, 9, 22), (4, "e", 0, 40, 9, 41)]
    rows = [(page, *t, 5000) for page, tokens in pages.items() for t in tokens] + [("back", 9, " \t", 0, 0, 9, 9, 1), ("back", 10, None, 0, 0, 9, 9, 1)]
    df = spark.createDataFrame(rows, "page string, place long, text string, left int, top int, right int, bottom int, confidence int")
    got = {}
    for r in ocr_rows.lines(df).orderBy("page", "line").collect():
        got.setdefault(r.page, []).append(r.text)
    assert got == {page: plain_rows(tokens) for page, tokens in pages.items()}


@pytest.mark.parametrize("spans, joined", [([(17, 18), (11, -19), (10, 15), (17, 7), (14, 24), (1, 1)], "w3 w2"), ([(14, -16), (18, -12), (1, -29), (18, -12), (1, 3), (14, 15), (8, 10), (14, 4)], "w3 w1")])
def test_returning_token(spark, spans, joined):
    """Boxes that are upside down, as four numbers may be, let a token (w3) return to the third-last row; to the fourth-last, which has w4, it may not."""
    rows = [("p", i, f"w{i}", i, top, 99, bottom) for i, (top, bottom) in enumerate(spans)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page string, place long, text string, left int, top int, right int, bottom int, confidence int")
    got = [r.text for r in ocr_rows.lines(df).orderBy("line").collect()]
    assert got == plain_rows([r[1:] for r in rows]) and joined in got


def test_boxes(spark):
    df = spark.createDataFrame([([[3.5, 1.0], [10.4, -2.0], [5.0, 8.5]], [1.5, 2.5, -1.0, 4.0], 0.99995), ([], [1.0], None), (None, None, -1.0), ([[1.0], None], [1.0, 2.0, 3.0, 4.0], 2.0)], "points array<array<double>>, four array<double>, score double")
    got = [(tuple(r.p), tuple(r.f), r.c) for r in df.select(ocr_rows.box(F.col("points")).alias("p"), ocr_rows.flat_box(F.col("four")).alias("f"), ocr_rows.confidence(F.col("score")).alias("c")).collect()]
    assert got == [((4, 0, 10, 8), (2, 2, 0, 4), 10000), ((0, 0, 0, 0), (0, 0, 0, 0), 0), ((0, 0, 0, 0), (0, 0, 0, 0), 0), ((0, 0, 0, 0), (1, 2, 3, 4), 10000)]


def test_ranges(spark):
    rng = random.Random(2)
    ranges = [("d", i, a := rng.randint(-50, 900), a + rng.choice([-1, 0, 1, 7, 64, 500])) for i in range(200)] + [("e", 0, 0, 3)]
    points = [("d", p) for p in range(-60, 1500, 7)] + [("e", 2), ("f", 2), ("d", None)]
    r = spark.createDataFrame(ranges, "k string, sequence long, first long, last long")
    p = spark.createDataFrame(points, "k string, page long")
    met = intervals.pages_in_ranges(p, r, "k", "page", "first", "last")
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.k, x.page, x.sequence) for x in met.collect()) == sorted((k, q, s) for k, q in points for kk, s, a, b in ranges if k == kk and q is not None and a <= q <= b)
    jobs = spark.createDataFrame([("d", i, s := rng.randint(0, 800), s + rng.randint(0, 60)) for i in range(100)], "k string, job long, start long, end long")
    want = {j.job: min((s for k, s, a, b in ranges if k == "d" and a <= j.start and j.end <= b), default=None) for j in jobs.collect()}
    assert {x.job: x.sequence for x in intervals.first_containing(jobs, r, "k").collect()} == want
    assert intervals.pages_in_ranges(p, r.where("false"), "k", "page", "first", "last").count() == 0


def test_valid_graph_has_no_breach(spark):
    nodes = spark.createDataFrame([("d", "a", 1, 1, None, ["b"], ["s1"], "x"), ("d", "b", 1, 2, "a", [], ["s2"], "y"), ("d", "c", 2, 3, None, None, ["s3"], "z")], "document string, node string, page long, place long, parent string, children array<string>, spans array<string>, text string")
    pages = spark.createDataFrame([("d", 1, ["a", "b"]), ("d", 2, ["c"])], "document string, page long, members array<string>")
    lines = spark.createDataFrame([("d", 1, "s1", "x"), ("d", 1, "s2", "y"), ("d", 2, "s3", "z"), ("d", 2, "s4", " ")], "document string, page long, span string, text string")
    records = spark.createDataFrame([("d", "tables", "t1", 1)], "document string, collection string, record string, page long")
    assert source_graph.audit_graph(nodes, pages, lines, records, records).count() == 0
    worse = {
        "REPEATED_NODE": (nodes.union(nodes.where("node = 'c'")), pages, lines, records), "REPEATED_PAGE": (nodes, pages.union(pages.where("page = 2")), lines, records), "PAGE_UNKNOWN_NODE": (nodes.where("node <> 'c'"), pages, lines, records),
        "NOT_ON_ITS_PAGE": (nodes, pages.where("page = 1"), lines, records), "NO_SPAN": (nodes.withColumn("spans", F.expr("if(node = 'c', array(), spans)")), pages, lines, records), "UNKNOWN_SPAN": (nodes, pages, lines.where("span <> 's3'"), records), "REPEATED_RECORD": (nodes, pages, lines, records.union(records)),
    }
    for breach, (n, p, s, r) in worse.items():
        assert breach in {x.breach for x in source_graph.audit_graph(n, p, s, r, records).collect()}


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, 400)))
    (tmp_path / "b.txt").write_text("only")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 400 and all(r.value.startswith(f"line {r.line} ") for r in rows if r.file.endswith("a.txt")) and [r.line for r in rows if r.file.endswith("b.txt")] == [1]


def test_statements(spark, tmp_path):
    text = "a;b 'x;''y' c;/* ; ' */d;'un;closed\n;'e;"
    (tmp_path / "s.txt").write_text(text)
    want = ["a", "b 'x;''y' c", "/* ; ' */d", "'un;closed\n;'e"]
    for size in (4, 9, 1000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            got = [r.text for r in statements(spark, str(tmp_path)).orderBy("statement").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == want
    assert [passed("'", s) for s in (0, 1, 2)] == [1, 0, 2] and passed("/*'*/", 0) == 0


def test_versions(spark, tmp_path):
    folder = tmp_path.as_uri()
    old = spark.createDataFrame([(1, "h", "t"), (2, "h", None)], "k long, hash string, title string")
    assert projection.publish(old, folder) == 1
    new = spark.createDataFrame([(2, "h", "filled"), (1, "other", "x"), (3, "h", "new")], old.schema)
    merged = projection.merged(projection.published(spark, folder), new, ["k"], ["hash"], ["title"], first_wins=True)
    assert {r.k: (r.hash, r.title, r.change) for r in merged.collect()} == {1: ("h", "t", "refused"), 2: ("h", "filled", "updated"), 3: ("h", "new", "inserted")}
    assert projection.publish(merged.drop("change"), folder) == 2
    assert projection.published(spark, folder).count() == 3 and projection.published(spark, folder, 1).count() == 2
    with pytest.raises(ValueError):
        projection.publish(old, folder, 2)
    old.limit(1).write.mode("overwrite").parquet(f"{folder}/version=2")
    with pytest.raises(ValueError):
        projection.published(spark, folder)


RULE = "rule_id string, ids_xml string, sidecar string, citation string, document_key string, document_sha256 string, page long, spans array<string>, declared_id string, declared_ids_sha256 string, decision string, attested_sha256 string, report_sha256 string, evidence string, attested_revision string, revision string"


def test_release(spark, tmp_path):
    rows = [(f"r{i}", f"<x>{i}</x>", '{"a":1}', "{}", "d", "h", 1, [f"s{i % 2}"], None, None, "anchored", "h", "0" * 64, None, None, None) for i in range(4)]
    compiled = spark.createDataFrame(rows, RULE)
    manifest = release.entries(compiled)
    name = release.write(compiled, manifest, tmp_path.as_uri())
    assert release.root(manifest.orderBy(F.desc("rule_id")).repartition(3)).first()["root"] == name and spark.read.parquet(f"{tmp_path.as_uri()}/{name}/rules").count() == 4
    assert tuple(release.coverage(manifest).first()) == (4, 1, 2)
    flipped = compiled.withColumn("ids_xml", F.expr("if(rule_id = 'r1', '<x>l</x>', ids_xml)"))
    assert [tuple(r) for r in release.releasable(flipped, manifest).collect()] == [("r1", "IDS_DIFFERS")]
    assert release.root(release.entries(flipped)).first()["root"] != name
    assert [tuple(r) for r in release.releasable(compiled.where("rule_id <> 'r2'"), manifest).collect()] == [("r2", "NOT_COMPILED")]
    assert [tuple(r) for r in release.releasable(compiled, manifest.where("rule_id <> 'r3'")).collect()] == [("r3", "NOT_IN_MANIFEST")]
    with pytest.raises(ValueError, match="r2"):
        release.write(compiled.where("rule_id <> 'r2'"), manifest, tmp_path.as_uri())


def test_each_candidate_once(spark):
    one = "bundle string, candidate string"
    candidates = spark.createDataFrame([("b", p, c) for p, c in (("a", "1"), ("a", "2"), ("b", "3"), ("b", "4"), ("a", "5"))], "bundle string, pass string, candidate string")
    accepted = spark.createDataFrame([("b", "t", [], []), ("b", "u", ["U"], [])], f"{one}, uncertainty array<string>, quality array<string>")
    merges = spark.createDataFrame([("b", "m1", "t", ["1", "3"]), ("b", "m2", "u", ["2"])], "bundle string, merge string, accepted string, sources array<string>")
    rejected, deferred = spark.createDataFrame([("b", "4")], one), spark.createDataFrame([], one)
    given = {"candidates": candidates, "accepted": accepted, "merges": merges, "rejected": rejected, "deferred": deferred}
    assert publication.faults(**given).count() == 0
    assert {r.candidate: (r.outcome, r.reason) for r in publication.outcomes(**given).collect()} == {"1": ("rule", None), "2": ("deferred", "ACCEPTED_CANDIDATE_HAS_UNCERTAINTY"), "3": ("rule", None), "4": ("rejected", None), "5": ("deferred", "VALIDATOR_UNACCOUNTED_SOURCE_CANDIDATE")}
    assert tuple(publication.summary(**given).first()) == ("b", 5, 2, 2, 1, 0, 1, "needs_review")
    wrong = given | {"rejected": spark.createDataFrame([("b", "1")], one)}
    assert [tuple(r) for r in publication.faults(**wrong).collect()] == [("b", "CLASSIFIED_TWICE", "1")]
    assert {r.reason for r in publication.outcomes(**wrong).collect()} == {"VALIDATOR_RECONCILIATION_FAILED"}
    empty = given | {"merges": merges.withColumn("sources", F.expr("if(merge = 'm2', array(), sources)"))}
    assert [r.fault for r in publication.faults(**empty).collect()] == ["INVALID_SOURCES"]


class Anchors(HTMLParser):
    """The plain machine: (number of the anchor, href, label)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.href, self.text, self.place, self.found = None, [], 0, []

    def end(self):
        if self.href is not None:
            self.found.append((self.place, self.href.strip(), " ".join("".join(self.text).split())))
        self.href, self.text = None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.end()
            self.href, self.place = dict(attrs).get("href"), self.place + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.end()

    def handle_data(self, data):
        self.text.append(data)


def test_page_links(spark):
    """Nested, unclosed and self-closed anchors, references, comments, quotes that hold >, scripts, pages without any."""
    pages = [
        "<a href='http://x'>one<b>two</b><a href=\"https://y?a=1&amp;b=2\">three</a>four", "<a>none</a><a href=>x</a><a href=http://q>un<!-- c --> closed &eacute; &lt;b&gt;", "<A HREF='a' href='http://last'/>after", "<a name=x href = \"http://z\" >  l \n l </a x>",
        "x < y <a href='http://s'>a < b</a>", "<a href='http://k'><script>var a='</b>';</script>t</a>", None, "", "<abbr href='http://no'>n</abbr><a\nhref='ftp://f'>f</a>", "<p title='a > b'><a href='http://g' title='>'>g</a></p></a>", "plain",
    ]
    want = []
    for key, html in enumerate(pages):
        parser = Anchors()
        parser.feed(html or "")
        parser.close()
        parser.end()
        want += [(key, *x) for x in parser.found]
    df = spark.createDataFrame(list(enumerate(pages)), "k long, html string")
    assert sorted(map(tuple, links.page_links(df, "k", "html", None).collect())) == sorted(want)
    assert {r.href for r in links.page_links(df, "k", "html").collect()} == {h for *_, h, _ in want if h.startswith("http")}


def test_chunk_orders(spark):
    from trivalent.operators import books

    sha = "0" * 64
    documents = spark.createDataFrame([("d", "ready", sha, 2)], "document string, state string, sha256 string, page_count long")
    jobs = spark.createDataFrame([("a", "d", 1, sha), ("b", "d", 1, sha), ("c", "d", 4, sha)], "job string, document string, chunk_order long, source_sha256 string")
    pages = spark.createDataFrame([(j, 1, p, f"sha256:{sha}:page:{p:06d}", o) for j, p, o in (("a", 1, False), ("b", 2, False), ("c", 2, True))], "job string, place long, page long, page_id string, overlap boolean")
    ledger = spark.createDataFrame([(j, "completed") for j in "abc"], "job string, status string")
    readings = pages.select("job", "place", "page_id", F.concat("job", F.lit("")).alias("text"))
    assert sorted((r.fault, r.item) for r in books.queue_faults(documents, jobs, pages, ledger, readings).collect()) == [("CHUNK_ORDER", "a"), ("CHUNK_ORDER", "c")]
    read = books.book_pages(jobs, pages, ledger, readings)
    assert {(r.page, r.overlap): r.agrees for r in read.collect()} == {(1, False): None, (2, False): None, (2, True): False}
    assert tuple(books.assembly_report(books.books(documents, read), ledger).first()) == (3, 3, 1, 1, 2, 2, 1, True)


def test_citations(spark):
    from trivalent.operators import contracts

    rows = [(1, '{"a": 1, "a": 2}'), (2, "{}"), (3, None)]
    got = {}
    for r in contracts.citation_faults(spark.createDataFrame(rows, "k long, c string"), "k", "c").collect():
        got.setdefault(r.k, set()).add(r.fault)
    assert got[1] == {"NOT_AN_OBJECT"} and got[3] == {"NO_CITATION"} and {"NO_DOCUMENT", "NO_PAGE", "UNKNOWN_STATUS", "NO_NODES", "NO_SPANS"} <= got[2]
