import hashlib
import json
import random
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import claims, entities, graph, models, retrieval, similarity, store, temporal
from chronoloom.plans import stages
from chronoloom.sources import issues, rest, tables
from chronoloom.streaming import ingest


def test_paired_intervals_equal_a_stack(spark):
    rng = random.Random(3)
    rows = [(i, f"issue_{rng.randrange(4)}", f"2024-01-{1 + i // 40:02d}T{i % 24:02d}:00:00Z", rng.choice(["AssignedTo", "Unassigned"]), rng.choice("ab")) for i in range(300)]
    df = spark.createDataFrame([(i, f"s{i}", s, t, e, a) for i, s, t, e, a in rows], "seq long, source_id string, subject string, ts string, event_type string, assignee string")
    got = {r.seq: r.valid_until for r in temporal.paired_intervals(df, "AssignedTo", "Unassigned", "assignee").collect()}
    open_, want = {}, {}
    for i, s, t, e, a in sorted(rows, key=lambda r: (r[2], r[0])):
        stack = open_.setdefault((s, a), [])
        if e == "AssignedTo":
            stack.append(i)
            want[i] = None
        elif stack:
            want[stack.pop()] = t
    assert got == want


def test_leaders_equal_a_scan(spark):
    rows = np.random.default_rng(1).normal(size=(60, 4))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    df = spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, block int, vector array<double>")
    got = {r.id: r.leader for r in similarity.leaders(df, 0.7).collect()}
    for block in (0, 1):
        heads = []
        for i in range(block, 60, 2):
            lead = next((h for h in heads if rows[h] @ rows[i] >= 0.7), None)
            heads += [i] if lead is None else []
            assert got[i] == (i if lead is None else lead)


@pytest.mark.parametrize("most", [6, 1_000_000])
def test_leaders_of_pairs_equal_a_scan_of_long_chains_too(spark, monkeypatch, most):
    monkeypatch.setattr(similarity, "FEW_LINKS", 0 if most < 1000 else 10_000)
    rng, size, others = random.Random(6), *((16, 8) if most < 1000 else (240, 60))
    links = {(i, i + 1) for i in range(size - 1)} | {(1000 + i, 1000 + j) for j in range(others) for i in range(j) if rng.random() < 0.1}
    links |= {(2000 + i, 2009) for i in range(9)} | {(5, 9999), (9998, 9999)}  # 9998 and 9999 are no rows
    ids = [*range(size), *range(1000, 1000 + others), *range(2000, 2010)]
    lead = {}
    for b in ids:
        lead[b] = min((a for a, other in links if other == b and lead.get(a) == a), default=b)
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    got = similarity.leaders_of(rows, spark.createDataFrame([(a, b, a / 10000) for a, b in links], "a long, b long, sim double"), most).collect()
    assert sorted((r.id, r.leader, r.sim) for r in got) == [(i, lead[i], 1.0 if lead[i] == i else lead[i] / 10000) for i in sorted(ids)]


def test_leaders_of_no_rows(spark):
    none = spark.createDataFrame([], "a long, b long, sim double")
    assert similarity.leaders_of(none.select(F.col("a").alias("id")), none).collect() == []


def sid(*parts):
    return hashlib.sha256("::".join(map(str, parts)).encode()).hexdigest()[:16]


RAW = [
    {"number": 1, "title": "T", "body": "b" * 2100, "html_url": "u1", "state": "closed", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-03T00:00:00Z", "labels": [{"name": "bug"}, {"name": "Old"}], "assignees": [{"login": "ann"}, {}], "pull_request": None,
     "comments_data": [{"id": 5, "body": "x" * 501, "created_at": "2024-01-02T00:00:00Z", "html_url": "c5"}, {"id": 5, "body": "again", "created_at": "2024-01-02T00:00:00Z"}, {"id": 6, "user": {"login": "cy"}}],
     "timeline_events": [{"id": 9, "event": "assigned", "created_at": "2024-01-02T00:00:00Z"}, {"id": 10, "event": "starred"}, {"event": "referenced", "created_at": "2024-01-02T00:00:00Z"}, {"event": "referenced", "created_at": "2024-01-05T00:00:00Z"}]},
    {"number": 2, "title": None, "user": {"login": "bob"}, "state": "open", "created_at": "2024-01-01T00:00:00Z", "assignees": [{"login": "dee"}],
     "timeline_events": [{"id": 11, "event": "labeled", "actor": {"login": "cy"}, "label": {"name": "bug"}, "created_at": None}, {"id": 12, "event": "unlabeled", "user": {"login": "eve"}, "label": {}, "created_at": "2024-01-02T00:00:00Z"},
                         {"id": 13, "event": "assigned", "actor": {}, "user": {"login": "no"}, "assignee": {}, "created_at": "2024-01-02T00:00:01Z"}, {"id": 14, "event": "milestoned", "created_at": "2024-01-02T00:00:02Z"}]},
    {"number": 3, "title": "P", "state": "open", "user": {"login": "bob"}, "created_at": "2024-01-04T00:00:00Z"},
]


@pytest.mark.parametrize("lines", [False, True])
def test_nested_issues_to_events(spark, tmp_path, lines):
    (tmp_path / "i.json").write_text("\n".join(map(json.dumps, RAW)) if lines else json.dumps(RAW))
    rows = issues.events(issues.read(spark, str(tmp_path / "i.json"), lines)).orderBy("seq").collect()
    got = [(r.subject, r.event_type, r.actor, r.timestamp, r.source_id, r.evidence, r.char_offset_end) for r in rows]
    first, second = "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"
    assert got == [
        ("issue_1", "CommentAdded", "cy", None, sid("CommentAdded", "issue_1", 6), "", 0),
        ("issue_2", "LabelAdded", "cy", None, sid("labeled", "issue_2", 11), "Label added: bug", None),
        ("issue_1", "IssueCreated", "unknown", first, sid("IssueCreated", "issue_1"), "T", None),
        ("issue_2", "IssueCreated", "bob", first, sid("IssueCreated", "issue_2"), "", None),
        ("issue_1", "AssignedTo", "system", first, sid("AssignedTo", "issue_1", "ann", "synthetic"), "Assigned to ann (from snapshot)", None),
        ("issue_1", "AssignedTo", "system", first, sid("AssignedTo", "issue_1", "unknown", "synthetic"), "Assigned to unknown (from snapshot)", None),
        ("issue_1", "CommentAdded", "unknown", second, sid("CommentAdded", "issue_1", 5), "x" * 500, 500),
        ("issue_1", "Referenced", "system", second, sid("referenced", "issue_1", ""), "Referenced in event ", None),
        ("issue_2", "LabelRemoved", "eve", second, sid("unlabeled", "issue_2", 12), "Label removed: ", None),
        ("issue_2", "AssignedTo", "system", "2024-01-02T00:00:01Z", sid("assigned", "issue_2", 13), "Assigned to unknown", None),
        ("issue_2", "MilestoneSet", "system", "2024-01-02T00:00:02Z", sid("milestoned", "issue_2", 14), "Milestone set: ", None),
        ("issue_1", "IssueClosed", "system", "2024-01-03T00:00:00Z", sid("IssueClosed", "issue_1", "synthetic"), "Issue state is 'closed' (synthesized from snapshot)", None),
        ("issue_3", "IssueCreated", "bob", "2024-01-04T00:00:00Z", sid("IssueCreated", "issue_3"), "P", None),
    ]
    made = {r.subject: r for r in rows if r.event_type == "IssueCreated"}
    assert [made[f"issue_{k}"].extra.is_pull_request for k in (1, 2, 3)] == [True, False, False]
    assert made["issue_1"].evidence_full == "b" * 2000 and made["issue_3"].evidence_full == "P" and made["issue_1"].extra.labels == ["bug", "Old"] and made["issue_2"].extra.labels == []
    assert (made["issue_1"].source_url, made["issue_2"].source_url) == ("u1", "") and [r.char_offset_start for r in rows if r.event_type == "CommentAdded"] == [0, 0]


def test_claims_and_entities_of_nested_issues(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps(RAW))
    stages.transform(spark, str(tmp_path / "i.json"), str(tmp_path))
    events = spark.read.parquet(str(tmp_path / "events"))
    found = {(r.predicate, r.subject, r.object, r.confidence) for r in claims.event_claims(events).collect()}
    assert {("is_pull_request", "issue_1", "true", 0.99), ("has_label", "issue_1", "bug", 0.95), ("has_label", "issue_1", "Old", 0.95), ("closed_by", "issue_1", "system", 0.85), ("externally_referenced", "issue_1", "system", 0.7)} <= found
    kinds = {r.canonical_name: (r.entity_type, list(r.properties.labels)) for r in entities.labelled_issues(events).collect()}
    assert kinds == {"issue_1": ("PullRequest", ["bug", "Old"]), "issue_2": ("Issue", []), "issue_3": ("Issue", [])}


class Answer:
    def __init__(self, body):
        self.body = body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None

    def read(self):
        return self.body


def test_load_waits_longer_after_each_failure_and_raises():
    waits, tried = [], []

    def failing(*_, **__):
        tried.append(1)
        raise OSError

    with pytest.raises(rest.PageLost):
        rest.load("http://x", open_url=failing, sleep=waits.append)
    assert waits == [2.0, 4.0] and len(tried) == 3

    def limited(*_, **__):
        tried.append(1)
        if len(tried) < 5:
            raise urllib.error.HTTPError("u", 429, "", {"Retry-After": "7"}, None)
        return Answer(b"[1]")

    assert rest.load("http://x", open_url=limited, sleep=waits.append) == [1] and waits[2:] == [7.0]
    now = rest.wait_after(urllib.error.HTTPError("u", 403, "", {"X-RateLimit-Reset": "130"}, None), 1, 2.0, 100.0)
    assert now == 31.0 and rest.wait_after(urllib.error.HTTPError("u", 404, "", {}, None), 1, 2.0, 0.0) is None


def test_pages_are_read_until_an_empty_one(spark):
    pages = {f"http://x?page={n}": [{"n": n, "i": i} for i in range(2)] for n in (1, 2, 3)}
    reader = rest.PagesReader({"url": "http://x?page={page}"}, lambda u: pages.get(u, []))
    assert [(n, json.loads(i)["i"]) for p in reader.partitions() for n, i in reader.read(p)] == [(n, i) for n in (1, 2, 3) for i in (0, 1)]
    two = rest.PagesReader({"url": "http://x?page={page}", "pages": "2"}, lambda u: pages.get(u, []))
    assert len(two.partitions()) == 2 and sum(len(list(two.read(p))) for p in two.partitions()) == 4

    def comments(url):
        key, page = (int(x) for x in url.rsplit("/", 2)[1:])
        return [{"of": key, "page": page}] if page <= key else []

    keys = spark.createDataFrame([(0,), (1,), (3,), (3,), (None,)], "number long")
    got = sorted((r.number, r.page, json.loads(r.item)["of"]) for r in rest.dependent(keys, "number", "http://x/{key}/{page}", comments).collect())
    assert got == [(1, 1, 1), (3, 1, 3), (3, 2, 3), (3, 3, 3)]


def test_store_loads_what_is_there_and_the_last_of_a_key(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "entity_id string, seq long, canonical_name string")
    assert store.save({"entities": rows}, str(tmp_path)) == [f"{tmp_path}/entities"]
    schemas = {"entities": "entity_id string, seq long, canonical_name string", "merge_log": "merge_id string"}
    got = store.load(spark, str(tmp_path), schemas)
    assert sorted((r.entity_id, r.canonical_name) for r in got["entities"].collect()) == [("a", "y"), ("b", "z")] and got["merge_log"].count() == 0
    assert store.first_with_rows(rows.where("false"), rows).count() == 3


def test_graph_drawing_and_tooltips(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A<b>", "Issue", "#4A90D9"), ("b", "B", "Person", "#50C878")], "id string, label string, type string, color string")
    edges = spark.createDataFrame([("a", "b", ["1", "2", "3", "4"], "active"), ("a", "z", ["x" * 400], None)], "from_id string, to_id string, evidence array<string>, status string")
    assert sorted((r.title, r.color) for r in graph.tooltips(edges).collect()) == [("1\n2\n3", "#666"), ("x" * 300, "#999")]
    graph.html(nodes, edges, str(tmp_path / "g.html"))
    page = (tmp_path / "g.html").read_text()
    assert page.count("<circle") == 2 and page.count("<line") == 1 and "A&lt;b&gt;" in page and "#50C878" in page


def test_candidate_pairs_are_exact_and_mostly_found(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(150, 16))
    rows = np.concatenate([rows, rows + rng.normal(size=rows.shape) * 0.25])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vector array<double>")
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if rows[i] @ rows[j] >= 0.85}
    got = {(r.a, r.b) for r in similarity.bucket_pairs(df, 0.85).collect()}
    assert got <= want and len(got) > 0.95 * len(want) > 100


@pytest.mark.parametrize("pack", [16, 8192])
def test_pairs_of_dealt_blocks_equal_all_comparisons(spark, monkeypatch, pack):
    monkeypatch.setattr(similarity, "PACK", pack)
    rng = np.random.default_rng(8)
    rows = [(f"r{i:03d}", "x" if i < 90 else f"y{i % 7}", [float(v) for v in rng.normal(size=3 if i % 10 else 4)]) for i in range(150)]
    rows += [("s0", None, [1.0, 2.0, 3.0]), ("s1", "x", None), ("s2", "x", [1.0, None, 3.0]), ("s3", "x", [float("nan")] * 3), (None, "x", [1.0, 1.0, 1.0]), ("s4", "x", []), ("s5", "x", []), ("s6", "x", [1e300] * 3)]
    rows += [(f"t{i}", "x", rows[5][2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, block string, vector array<double>")
    for block in ("block", None):
        def known(i, j):
            (a, x, u), (b, y, v) = rows[i], rows[j]
            if None in (a, b, u, v) or None in u or None in v or len(u) != len(v) or block and (x != y or x is None):
                return None
            sim = 0.0
            for p, q in zip(u, v):
                sim += p * q
            return (min(a, b), max(a, b), repr(sim)) if not sim < 0.8 else None

        want = {known(i, j) for i in range(len(rows)) for j in range(i)} - {None}
        got = similarity.pairs(df, 0.8, block).collect()
        assert len(got) == len(want) > 800 and {(r.a, r.b, repr(r.sim)) for r in got} == want


@pytest.mark.parametrize(("pack", "above"), [(16, None), (16, 0.3), (8192, 0.3)])
def test_nearest_rows_of_dealt_queries_equal_all_comparisons(spark, monkeypatch, pack, above):
    monkeypatch.setattr(similarity, "PACK", pack)
    monkeypatch.setattr(similarity, "QUERY_PACK", pack // 4)
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, None), (301, [1.0, None, 2.0, 3.0]), (302, [float("nan")] * 4), (303, [1e300] * 4)]
    asked = [(f"q{i}", v) for i, v in rows if v and None not in v and i % 3 == 1]
    want = []
    for qid, u in asked:
        sims = []
        for i, v in rows:
            if v and None not in v:
                sim = 0.0
                for x, y in zip(u, v):
                    sim += x * y
                sims.append((sim == sim, -sim if sim == sim else 0.0, i, sim))
        want += [(qid, i, repr(sim), n + 1) for n, (_, _, i, sim) in enumerate(sorted(sims)[:5]) if above is None or not sim <= above]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = similarity.nearest_each(spark.createDataFrame([*asked, ("none", None)], "qid string, vector array<double>"), df, 5, above)
    assert sorted((r.qid, r.id, repr(r.sim), r.place) for r in got.select("qid", "id", "sim", "place").collect()) == sorted(want)


def test_near_comments_keep_the_earlier(spark):
    rows = [("issue_1", 1, "s1", "please merge the fix for the parser"), ("issue_1", 2, "s2", "Please merge the fix for the parser!"), ("issue_2", 3, "s3", "please merge the fix for the parser"), ("issue_1", 4, "s4", "something else entirely")]
    kept, log = similarity.near_comments(spark.createDataFrame(rows, "subject string, seq long, source_id string, body string"), models.embedded)
    assert sorted(r.source_id for r in kept.collect()) == ["s1", "s3", "s4"] and [(r.target_id, r.merged_ids, r.merge_type) for r in log.collect()] == [("s1", "s2", "artifact")]


def test_conflicts_are_found_by_subject_too(spark):
    found = spark.createDataFrame([(1, "issue_1")], "qid int, name string")
    rows = spark.createDataFrame([("Issue_1", "issue_1", "a", "low"), (None, "ISSUE_1", "b", "low"), ("issue_2", None, "c", "low")], "issue_id string, subject string, conflict_type string, severity string")
    assert [r.conflict_type for r in retrieval.conflicts_of(found, rows).orderBy("place").collect()] == ["a", "b"]


def test_ingest_twice_keeps_each_event_once(spark, tmp_path):
    events = tables.table(spark, "/root/testdata/sf0.001", "events")
    events.limit(200).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(ingest.watch(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        events.limit(200).write.mode("append").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200


def test_stages_run_over_a_folder(spark, tmp_path):
    tables.canonical_events(tables.table(spark, "/root/testdata/sf0.001", "events")).write.parquet(str(tmp_path / "events"))
    assert list(stages.run(spark, str(tmp_path))) == list(stages.STAGES)
    assert spark.read.parquet(str(tmp_path / "edges")).count() > 0
    rows, kept, log = (spark.read.parquet(str(tmp_path / t)) for t in ("claims", "canonical_claims", "merge_log"))
    assert rows.count() == kept.count() + (log.agg(F.sum(F.size(F.split("merged_ids", ",")))).first()[0] or 0)
    assert spark.read.parquet(str(tmp_path / "packs")).count() == len(stages.EXAMPLES)


def test_issues_reach_the_stages(spark, tmp_path):
    raw = [{"number": 1, "title": "T", "state": "closed", "created_at": "2024-01-01T00:00:00Z", "closed_at": "2024-01-01T00:05:00Z", "user": {"login": "ann"}, "comments_data": [{"id": 5, "body": "this is approved", "created_at": "2024-01-02T00:00:00Z"}]}]
    (tmp_path / "i.json").write_text(json.dumps(raw))
    stages.transform(spark, str(tmp_path / "i.json"), str(tmp_path))
    stages.run(spark, str(tmp_path), ["temporal", "claims", "entities"])
    assert [(r.state, r.valid_until) for r in spark.read.parquet(str(tmp_path / "states")).orderBy("seq").collect()] == [("open", "2024-01-01T00:05:00Z"), ("closed", None)]
    assert claims.comment_claims(spark.read.parquet(str(tmp_path / "comments"))).where("claim_type = 'Decision'").count() == 1


def test_embedding_gives_unit_vectors(spark):
    df = spark.createDataFrame([(1, "open the issue"), (2, "OPEN the issue!"), (3, None), (4, "quite another thing")], "id int, text string")
    got = {r.id: np.array(r.v) for r in df.select("id", models.embedded(F.col("text")).alias("v")).collect()}
    assert got[1] @ got[2] > 0.999 and abs(np.linalg.norm(got[4]) - 1) < 1e-9 and not got[3].any() and got[1] @ got[4] < 0.5


def test_completion_tries_again_and_gives_up(spark):
    def make():
        seen = {}

        def ask(text):
            seen[text] = seen.get(text, 0) + 1
            if text == "raises":
                raise OSError
            return {"noisy": "so: [1]", "late": "[" if seen[text] == 1 else "[]"}.get(text, "no array")

        return ask

    df = spark.createDataFrame([("noisy",), ("late",), ("raises",), ("never",), (None,)], "p string").coalesce(1)
    got = dict(df.select("p", models.completed(F.col("p"), make, wait=0.0)).collect())
    assert got == {"noisy": "so: [1]", "late": "[]", "raises": None, "never": None, None: None}


def test_extracted_claims_are_validated_and_kept_once(spark):
    answers = {
        1: json.dumps([{"claim_type": "LabelAction", "subject": "s", "predicate": "p", "confidence": 7, "excerpt": "e"}, {"claim_type": "Blocks", "confidence": "high", "excerpt": "x" * 600}, {"confidence": 0.1, "excerpt": "weak"}, {"confidence": 0.9}]),
        2: 'Sure! [{"claim_type": "Generic", "subject": "s", "predicate": "p", "excerpt": "again"}]',
        3: "nothing to read",
    }
    rows = spark.createDataFrame([(f"issue_{k}", k, "ann", f"c{k}", f"this fixes number {k} at last") for k in answers], "subject string, seq long, actor string, source_id string, body string")
    answer = lambda p: F.coalesce(*(F.when(p.contains(f"number {k} "), F.lit(a)) for k, a in answers.items()))
    got = [(r.seq, r.subject, r.claim_type, r.predicate, r.confidence, len(r.excerpt)) for r in claims.extracted(rows, answer).orderBy("seq", "claim_type").collect()]
    assert got == [(1, "issue_1", "Blocks", "blocks", 0.5, 500), (1, "s", "Generic", "p", 1.0, 1)]


def test_similar_rows_join_the_keyword_hits(spark):
    words = retrieval.question_words(spark.createDataFrame([(1, "What about ann?")], "qid int, question string"))
    names = spark.createDataFrame([("e1", "Bob", "bob,Ann"), ("e2", "Cy", ""), ("e3", "Dee", None)], "entity_id string, canonical_name string, aliases string")
    near = spark.createDataFrame([(1, "e1", 0.9), (1, "e2", 0.4)], "qid int, id string, sim double")
    found = retrieval.resolve(words, names, near)
    assert [(r.entity_id, r.score) for r in found.orderBy("place").collect()] == [("e1", 0.8), ("e2", 0.4)]
    rows = [("c1", "ann", "p", None, None, 0.5, "", "s1"), ("c2", "zed", "p", None, None, 0.5, "", "s2"), ("c3", "zed", "q", None, None, 0.5, "", "s3"), ("c4", "e2", "p", None, None, 0.5, "x", "s4")]
    said = spark.createDataFrame(rows, "claim_id string, subject string, predicate string, object string, value string, confidence double, excerpt string, source_id string")
    near = spark.createDataFrame([(1, "c1", 0.6), (1, "c2", 0.5)], "qid int, id string, sim double")
    got = [(r.claim_id, r.score) for r in retrieval.score_claims(words, found, said, near).orderBy("place").collect()]
    assert got == [("c1", 1.1), ("c4", 0.8), ("c2", 0.4)]
