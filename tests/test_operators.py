"""Operators on small inputs, with nulls, ties and repeats."""

import collections
import csv
import http.server
import json
import math
import random
import re
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from larkspur.functions import prefilter
from larkspur.functions import rules as R
from larkspur.functions import text as T
from larkspur.operators import classify, evaluate, retrieval, sampling
from larkspur.operators import conversations as C
from larkspur.operators.graph import connected_components
from larkspur.operators.ranks import ranked
from larkspur.sources import files, split_csv


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "expected"), [
    (None, ""), ("", ""), ("@bob see https://a.b/c?d  NOW", "see now"), ("  A\tB\n c ", "a b c"), ("@josé hi", "hi"),
])
def test_normalized(spark, text, expected):
    assert one(spark, T.normalized(F.col("x")), text) == expected


@pytest.mark.parametrize(("text", "intents"), [
    (None, []), ("éios", []), ("my ios!", ["software_update_os"]), ("Battery and WI-FI", ["battery_power_charging", "connectivity_network"]),
])
def test_intents(spark, text, intents):
    found = one(spark, classify.intent_matches(T.normalized(F.col("x"))), text)
    assert [m["intent_id"] for m in found] == intents


def test_primary_tie_goes_to_the_first(spark):
    assert one(spark, classify.primary_intent(classify.intent_matches(T.normalized(F.col("x")))), "wifi battery") == "battery_power_charging"


@pytest.mark.parametrize(("reply", "kind"), [(None, "none"), ("  ", "none"), ("Why?", "diagnostic_question"), ("Tap reset", "direct_guidance"), ("send a DM", "generic_routing"), ("ok", "acknowledgement_or_other")])
def test_response_type(spark, reply, kind):
    assert one(spark, classify.response_type(F.col("x")), reply) == kind


@pytest.mark.parametrize(("text", "reason"), [
    ("", "empty_or_non_informative"), (None, "empty_or_non_informative"), ("a b " * 30, "low_token_diversity"), ("x x x x x a b c d e", "repeated_token_noise"),
    ("it costs Ã©t here", "mojibake_or_unicode_artifact"), ("plain words stand here", None), ("I️I️I️I️ fine", "mojibake_or_unicode_artifact"),
])
def test_row_quality(spark, text, reason):
    assert one(spark, classify.row_quality(F.col("x")), text) == reason


def test_times(spark):
    assert str(one(spark, T.message_time(F.col("x")), "Tue Oct 31 22:10:47 +0000 2017")) == "2017-10-31 22:10:47"
    assert one(spark, T.message_time(F.col("x")), "never") is None and one(spark, T.message_time(F.col("x")), None) is None


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(12)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_quota_is_largest_remainder(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2), ("d", 2)], "group string, n long")
    got = {r.group: r.quota for r in sampling.quota_allocation(counts, 7).collect()}
    assert got == {"a": 3, "b": 2, "c": 1, "d": 1} and sum(got.values()) == 7


def test_greedy_equals_sequential(spark):
    rng = random.Random(9)
    conflicts = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    accepted = []
    for k in range(40):
        if not any((a, k) in set(conflicts) for a in accepted):
            accepted.append(k)
    items = spark.createDataFrame([(k,) for k in range(40)], "item int")
    got = sampling.greedy_accept(items, spark.createDataFrame(conflicts, "earlier int, later int"))
    assert sorted(r.item for r in got.where("accepted").collect()) == accepted


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(14)]
    texts = [" ".join(rng.sample(words, rng.randint(3, 10))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    expected = set()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            s, t = set(a.split()), set(b.split())
            if i < j and min(len(s), len(t)) >= 6 and len(s & t) >= 4 and len(s & t) >= 0.7 * min(len(s), len(t)) and len(s | t) >= 6:
                expected.add((i, j))
    assert {(r.left_id, r.right_id) for r in sampling.near_duplicate_pairs(df, "id", "text").collect()} == expected


def test_agreement_without_variance(spark):
    rows = spark.createDataFrame([(1, 2), (1, 3), (None, 3)], "h int, j int")
    got = evaluate.agreement(rows, "h", "j").first()
    assert (got.n, got.mean_absolute_error, got.pearson) == (2, 1.5, None)


def test_judge_reads_booleans_strictly(spark):
    rows = spark.createDataFrame([("q", "a b", "b c")], "query_id string, query string, response string")
    got = evaluate.judge(rows, lambda p: {"retrieval_relevance_1_5": 2, "response_grounding_1_5": 2, "response_quality_1_5": 1, "escalation_correct": "false", "overall_acceptable": "True"}).first()
    assert got.escalation_correct is False and got.acceptable is True


def test_csv_jsonl_and_digest(spark, tmp_path):
    row = ("1", "u", "True", "Tue Oct 31 22:10:47 +0000 2017", 'two\nlines, "quoted"', "2,3", None)
    df = spark.createDataFrame([row], files.MESSAGE_SCHEMA)
    df.write.options(header=True, escape='"').csv(str(tmp_path / "c"))
    back = files.read_messages_csv(spark, str(tmp_path / "c"))
    assert back.first()["text"] == row[4] and C.links(back, "response_ids").count() == 2
    files.write_jsonl(df, str(tmp_path / "j"), sorted_keys=True)
    again = files.read_jsonl(spark, str(tmp_path / "j"), files.MESSAGE_SCHEMA)
    assert again.first() == df.first() and files.digest(again) == files.digest(df)
    with pytest.raises(ValueError, match="missing columns: text"):
        C.require_columns(df.drop("text"))


def test_corrupt_lines_are_told_apart(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    rows, bad = files.read_jsonl_with_errors(spark, str(tmp_path / "x.jsonl"), StructType([StructField("a", LongType())]))
    assert sorted(r.a for r in rows.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]


def test_rules_on_a_stream(spark, tmp_path):
    from larkspur.streaming.rules import classify_stream

    df = spark.createDataFrame([("1", "u", "True", None, "refund my battery", None, None)], files.MESSAGE_SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    stream = classify_stream(spark.readStream.schema(files.MESSAGE_SCHEMA).parquet(str(tmp_path / "in")))
    q = stream.select("message_id", "bucket").writeStream.format("memory").queryName("classified").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("classified").collect()] == [("1", "multi_intent")]


def test_labels_must_be_filled_in(spark, tmp_path):
    rows = spark.createDataFrame([("q1", ' said "so"\n'), ("q2", None)], "query_id string, said string")
    files.write_sheet(rows, str(tmp_path / "s"), ("grade",))
    schema = "query_id string, said string, grade int"
    assert sorted(r.query_id for r in files.read_labels(spark, str(tmp_path / "s"), schema, ()).collect()) == ["q1", "q2"]
    assert {r.said for r in files.read_labels(spark, str(tmp_path / "s"), schema, ()).collect() if r.query_id == "q1"} == {' said "so"\n'}
    with pytest.raises(ValueError, match="incomplete: grade"):
        files.read_labels(spark, str(tmp_path / "s"), schema, ("grade",))


def test_json_documents(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, "é")], "a int, b string").orderBy("a")
    files.write_document(spark, files.json_array(rows), str(tmp_path / "a"))
    assert [tuple(r) for r in files.read_json_document(spark, str(tmp_path / "a"), "a int, b string").orderBy("a").collect()] == [(1, "é"), (2, None)]
    with pytest.raises(ValueError, match="more than 1 rows"):
        files.json_array(rows, limit=1)


@pytest.mark.parametrize(("text", "number"), [("GS-007", 7), ("GS-120", 120), ("GS-000", 0), ("GS", None), (None, None), ("GS-x", None)])
def test_id_suffix(spark, text, number):
    assert one(spark, T.id_suffix(F.col("x")), text) == number


def greedy(texts, quota):
    """What the pool does, one text after the other: (accepted places, pairs of rejected and accepted places)."""
    accepted, waiting, pairs = [], [], []
    for k, words in enumerate(texts):
        if len(accepted) == quota:
            break
        alike = any(words == texts[a] or len(set(words) & set(texts[a])) >= max(4, 0.7 * min(len(set(words)), len(set(texts[a])))) and len(set(words)) >= 6 for a in accepted)
        if alike:
            waiting.append(k)
            continue
        accepted.append(k)
        if waiting and len(pairs) < 10:
            pairs.append((waiting.pop(0), k))
    return accepted, pairs


@pytest.mark.parametrize("quota", [3, 9, 100])
def test_pool_and_replacements_against_one_by_one(spark, quota):
    rng = random.Random(quota)
    vocabulary = [f"word{k:02d}x" for k in range(13)]
    texts = [rng.sample(vocabulary, 8) for _ in range(30)]
    texts = [texts[rng.randrange(30)] if k % 4 == 3 else t for k, t in enumerate(texts)]
    rows = [(f"{k:03d}", " ".join(t), "ambiguous", None, 1, 100 - k, 1, None) for k, t in enumerate(texts)]
    classified = spark.createDataFrame(rows, "message_id string, text string, bucket string, primary string, evidence_strength int, words int, conversation_length int, created_at string")
    quotas = spark.createDataFrame([("ambiguous", "", quota)], "bucket string, intent string, quota long")
    filtered = sampling.quality_filtered(classified)
    accepted, pairs = greedy(texts, quota)
    assert sorted(int(r.message_id) for r in sampling.pool_select(filtered, quotas).collect()) == accepted
    assert sorted((int(r.rejected_id), int(r.replacement_id)) for r in sampling.replacement_pairs(filtered, quotas).collect()) == sorted(pairs)
    if quota > len(accepted):
        with pytest.raises(ValueError, match="differs from its quotas"):
            sampling.check_selection(sampling.pool_select(filtered, quotas), quotas)
    else:
        sampling.check_selection(sampling.pool_select(filtered, quotas), quotas)


def test_greedy_refuses_a_circle(spark):
    with pytest.raises(ValueError, match="circle"):
        sampling.greedy_accept(spark.createDataFrame([(1,), (2,)], "item int"), spark.createDataFrame([(1, 2), (2, 1)], "earlier int, later int"))


@pytest.mark.parametrize("reply", ['{"overall_acceptable": true}', '```json\n{"overall_acceptable": true}\n```', '```\n{"overall_acceptable": true}\n```'])
def test_judge_over_http(reply):
    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            calls.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            if len(calls) == 1:
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": reply if len(calls) > 2 else "no json"}}]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/chat"
    assert evaluate.http_judge(url, "k", "m", pause=0.01)({"query": "q"}) == {"overall_acceptable": True} and len(calls) == 3
    with pytest.raises(ValueError):
        calls[:] = [0]
        evaluate.http_judge(url, "k", "m", pause=0.01, attempts=1)({"query": "q"})
    server.shutdown()


def test_volumes_of_a_stream(spark, tmp_path):
    """Late messages within the watermark count; those behind it do not."""
    from larkspur.streaming.rules import intent_volumes

    def arrive(name, *times):
        rows = [(str(k), "u", "True", f"Tue Oct 31 {t} +0000 2017", "wifi", None, None) for k, t in enumerate(times)]
        spark.createDataFrame(rows, files.MESSAGE_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    arrive("a", "10:05:00", "10:50:00")
    source = spark.readStream.schema(files.MESSAGE_SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = intent_volumes(source).writeStream.outputMode("append").format("memory").queryName("volumes").start()
    try:
        for name, times in (("b", ["10:59:00", "16:00:00"]), ("c", ["10:10:00", "20:00:00"])):
            q.processAllAvailable()
            arrive(name, *times)
        q.processAllAvailable()
    finally:
        q.stop()
    got = {str(r.window.start)[11:16]: r.n for r in spark.table("volumes").collect()}
    assert got["10:00"] == 3 and got.get("16:00") == 1


def test_ranks_equal_row_numbers(spark):
    """Groups of all sizes, one of them most of the rows, null among them, over more ranges than groups."""
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([1, 2, None]), rng.randrange(50), k) for k in range(3_000)]
    table = spark.createDataFrame(rows, "g string, h int, v int, id int")
    order = [F.desc("v"), F.col("id").asc()]
    found = ranked(table, ["g", "h"], order, "r")
    assert found.columns == ["g", "h", "v", "id", "r"] and "Window" not in found._jdf.queryExecution().toString()
    own = Window.partitionBy("g", "h").orderBy(*order)
    assert sorted(found.collect(), key=lambda r: r.id) == sorted(table.withColumn("r", F.row_number().over(own)).collect(), key=lambda r: r.id)
    assert ranked(table.limit(0), ["g"], order, "r").collect() == []


def test_no_window_is_keyed_by_bucket(spark, sf_dir):
    from larkspur.plans.registry import QUERIES

    for name in ("bucket_rank", "golden_rank", "pool_select", "replacement_pairs", "quality_rejections"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Window \[.*\], \[bucket", plan), name


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(100, 300)] + [(0, k) for k in range(1, 60)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)] + [(700, 700), (None, 3), (701, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    told, table = [], spark.createDataFrame(edges + edges[:50], "src int, dst int")
    assert {r.node: r.component for r in connected_components(table).collect()} == {n: root(n) for n in parent}
    found = connected_components(table, last=0, told=told)
    assert {r.node: r.component for r in found.collect()} == {n: root(n) for n in parent}
    # The path of 200 edges and all else: what is left falls from round to round, to none.
    assert told[-1] == 0 and all(x > y for x, y in zip(told, told[1:])) and len(told) <= 14


@pytest.mark.parametrize("fold_items", [0, 4, 200])
def test_greedy_by_components_equals_one_by_one(spark, fold_items):
    rng = random.Random(3)
    conflicts = [(k, k + 1) for k in range(20)] + [tuple(sorted(rng.sample(range(30 + 6 * g, 36 + 6 * g), 2))) for g in range(10) for _ in range(7)]
    accepted = set()
    for k in range(100):
        if not any(e in accepted for e, x in conflicts if x == k):
            accepted.add(k)
    found = sampling.greedy_accept(spark.range(100).selectExpr("cast(id as int) item"), spark.createDataFrame(conflicts, "earlier int, later int"), fold_items=fold_items)
    assert {r.item for r in found.collect() if r.accepted} == accepted and found.count() == 100


@pytest.mark.parametrize("heavy", [3, 10_000])
def test_candidate_sets_lose_no_pair_and_are_few(spark, heavy):
    rng = random.Random(11)
    vocabulary = [f"word{k:03d}x" for k in range(300)]
    texts = [rng.sample(vocabulary[:40], rng.randint(6, 14)) + rng.sample(vocabulary, 5) for _ in range(150)]
    texts += [t[: len(t) - rng.randint(0, 4)] for t in texts[:60]]
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "id int, text string")
    sets = sampling.token_sets(docs, "id", "text", least=6)
    forms = sampling.forms_of(sets)
    candidates = {frozenset((r.a, r.b)) for r in sampling.candidate_sets(forms, heavy=heavy).collect()}
    own = {r.id: (r.form, set(r.tokens)) for r in sets.collect()}
    exact = {frozenset((f, g)) for f, a in own.values() for g, b in own.values() if f != g and len(a & b) >= max(4, 0.7 * min(len(a), len(b)))}
    meeting = sum(bool(a & b) for x, (f, a) in own.items() for y, (g, b) in own.items() if x < y and f != g)
    assert exact <= candidates and len(candidates) < 0.5 * meeting


@pytest.mark.parametrize("most_listed", [7, 500])
def test_pairs_of_many_copies_are_dealt_out(spark, most_listed):
    """All pairs of copies and near copies, each once, and with short lists not in one task."""
    texts = ["battery drains screen freezes charging overnight update"] * 60 + ["battery drains screen freezes charging overnight"] * 40 + ["network wifi router password locked account"]
    docs = spark.createDataFrame([(f"{k:03d}", t) for k, t in enumerate(texts)], "id string, text string")
    frame = sampling.near_duplicate_pairs(docs, "id", "text", most_listed=most_listed)
    got = sorted((r.left_id, r.right_id, r.shared) for r in frame.collect())
    assert got == [(f"{a:03d}", f"{b:03d}", 7 if b < 60 else 6) for a in range(100) for b in range(a + 1, 100)]
    assert "REPARTITION_BY_COL" in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("first_block", [1, 3, 20, 64])
def test_search_equals_comparing_with_every_document(spark, first_block):
    """Texts of frequent tokens alone, copies within and across conversations, and texts without tokens."""
    rng = random.Random(5)
    common, rare = [f"word{k}" for k in range(6)], [f"seldom{k}" for k in range(60)]
    texts = [" ".join(rng.choices(common, k=rng.randint(1, 5)) + rng.sample(rare, rng.choice([0, 0, 1, 2]))) for _ in range(220)]
    texts += [texts[k % 7] for k in range(60)] + ["", "a", "word0"] * 3
    rows = [(f"{k:04d}", rng.choice([1, 1, 1, *range(2, 60)]), t) for k, t in enumerate(texts)]
    corpus = spark.createDataFrame(rows, "message_id string, conversation_id int, text string")
    tokens = [re.findall("[a-z0-9]{3,}", t) for t in texts]
    df = collections.Counter(t for own in tokens for t in set(own))
    vectors = []
    for own in tokens:
        w = {t: n * (math.log((len(texts) + 1) / (df[t] + 1)) + 1) for t, n in collections.Counter(own).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors.append({t: x / norm for t, x in w.items()})
    expected = {}
    for (query, home, _), q in zip(rows, vectors):
        scores = [(-round(sum(x * d[t] for t, x in q.items() if t in d), 9), doc) for (doc, other, _), d in zip(rows, vectors) if other != home and doc != query]
        expected |= {(query, r): (doc, -s) for r, (s, doc) in enumerate(sorted(x for x in scores if x[0] < 0)[:5], 1)}
    told = []
    found = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.search(corpus, corpus, first_block=first_block, told=told).collect()}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in expected.items()}
    assert all(math.isclose(found[k][1], expected[k][1], abs_tol=2e-9) for k in expected)
    # Fewer postings are met than those of all tokens of all different texts.
    assert told[0] < sum(df[t] for own in {tuple(sorted(set(o))) for o in tokens} for t in own)


def test_search_writes_no_pairs_and_blocks_do_not_change_it(spark, monkeypatch):
    """Texts that all share words: what is written grows with the texts and not with their pairs. Null homes take no places."""
    rng = random.Random(23)
    words = [f"word{k}" for k in range(40)]
    rows = [(f"{k:04d}", rng.choice([None, *range(40)]), " ".join([*words[:6], *rng.sample(words, 8)])) for k in range(400)]
    corpus = spark.createDataFrame(rows, "message_id string, conversation_id int, text string")
    written, write = [], retrieval.materialise

    def counted(df):
        written.append((out := write(df)).count())
        return out

    monkeypatch.setattr(retrieval, "materialise", counted)
    found = sorted(retrieval.search(corpus, corpus, least_blocks=2).collect())
    assert max(written) < len(rows) * 50 and len(found) == 5 * sum(h is not None for _, h, _ in rows)
    assert not {r.doc_id for r in found} & {m for m, h, _ in rows if h is None}
    monkeypatch.undo()
    blocks = sorted(retrieval.search(corpus, corpus, first_block=3, documents_a_block=150, asked_a_block=90, least_blocks=1).collect())
    assert blocks == found


def shuffle_files(spark):
    """Those that lie in the session's own folders."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.splitlines() if "/shuffle_" in f}


def test_retrieval_leaves_no_shuffles_behind(spark, monkeypatch):
    """Each table that is written frees its shuffles at once, and a wave of blocks is met after the other's are gone."""
    rows = [(f"{k:04d}", k, f"word{k % 7} word{k % 5} word{k % 3} other{k}") for k in range(60)]
    corpus = spark.createDataFrame(rows, "message_id string, conversation_id int, text string").repartition(4)
    began, most, write = shuffle_files(spark), [], retrieval.materialise

    def counted(df):
        out = write(df)
        most.append(len(shuffle_files(spark) - began))
        return out

    monkeypatch.setattr(retrieval, "materialise", counted)
    found = sorted(retrieval.search(corpus, corpus).collect())
    # What a count or collect shuffles is not written, and few files.
    assert max(most) <= 8
    tables, most[:] = len(most), []
    waves = sorted(retrieval.search(corpus, corpus, documents_a_block=20, asked_a_block=20, least_blocks=9, blocks_a_wave=3).collect())
    assert waves == found and len(most) > tables
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(key, "false") == "false"


def test_best_evidence_is_written_before_texts_are_moved(spark):
    """Decisions' plan begins at the written best rows, so evidence is not shuffled beside the responses."""
    corpus = retrieval_frames(spark, [(str(k), k, f"router wifi drops {k % 3}", "restart the router") for k in range(9)])
    texts = corpus.select("message_id", "conversation_id", "text")
    rows = retrieval.results(corpus, retrieval.search(texts, texts), corpus)
    decided = retrieval.decide(retrieval.grounded(corpus, retrieval.evidence(rows), corpus))
    assert "doc_words" not in decided._jdf.queryExecution().optimizedPlan().toString()


def test_search_of_nothing(spark):
    corpus = spark.createDataFrame([], "message_id string, conversation_id int, text string")
    assert retrieval.search(corpus, corpus).collect() == []


def test_a_top_n_is_cut_before_it_is_shuffled(spark):
    rows = spark.range(1000).selectExpr("id % 3 g", "id")
    plan = retrieval.first_of(rows, ["g"], [F.col("id").asc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search("WindowGroupLimit.*Partial", plan) and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_prefilter_loses_no_pattern(spark):
    """Texts made of pieces of the patterns, at the beginning, inside and beside other words and signs."""
    rng = random.Random(2)
    patterns = [p for _, own in R.INTENTS for p in own]
    assert sum(prefilter.openings(p) is None for p in patterns) <= 1
    bits = sorted({o for p in patterns for o in prefilter.openings(p) or ()}) + ["won't turn on", "wi-fi", "wifi", "face time", "facetime", "sent a message", "messages not", "charge for", "set up", "updates", "calls", "é", "x", "9", "_", "-", "'", "..."]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "", "-", "s ", ", "]) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in [*texts, *bits, "", None]], "x string")
    plain = F.filter(F.array(*(F.struct(F.lit(i).alias("intent_id"), classify.present(*(F.when(classify.hits(F.col("x"), p), F.lit(p)) for p in own)).alias("evidence")) for i, own in R.INTENTS)), lambda m: F.size(m["evidence"]) > 0)
    found = rows.select("x", classify.intent_matches(F.col("x")).alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in found) and sum(bool(r.a) for r in found) > 100


@pytest.mark.parametrize("block", [300, 5_000, 1 << 20])
def test_csv_is_cut_at_true_ends(spark, tmp_path, block):
    rng = random.Random(block)
    cells = ["plain", 'said "x"', "a,b", "line\nbreak", "\n\n", "", '"', 'in\r\nside', "é漢 " * 30, "x\n" * 60, " blank ", '""', '"\n"']
    rows = [(str(k), rng.choice(cells), rng.choice(["", "z"])) for k in range(500)] + [("long", 'y"\n,' * 2_000, "z")]
    for name, part, ends in (("a", rows[:300], "\n"), ("b", rows[300:], "\r\n")):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator=ends).writerows([("id", "text", "z"), *part])
    with open(tmp_path / "c.csv", "wb") as f:
        f.write(b'id,text,z\n\nbad,\xff\xfe,z\n"open,"",\nto the end')
    with open(tmp_path / "d.csv", "wb") as f:
        f.write(b"id,text,z\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        schema = S.StructType([S.StructField(c, S.StringType()) for c in ("id", "text", "z")])
        found = split_csv.read_csv(spark, str(tmp_path), schema)
        got = sorted((r.id, r.text or "", r.z or "") for r in found.collect())
        assert got == sorted([*rows, ("bad", "��", "z"), ('open,",\nto the end', "", "")])
        # One file is read by as many tasks as it has blocks.
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() >= (tmp_path / "a.csv").stat().st_size // block
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_verdicts_are_asked_for_once(spark, tmp_path):
    """A server that counts its calls, and fails for one query until it is told otherwise."""
    calls, broken = [], ["q7"]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"])["case"]
            calls.append(asked["query_id"])
            if asked["query_id"] in broken:
                self.send_error(400)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": '{"retrieval_relevance_1_5": 4, "overall_acceptable": "false"}'}}]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = evaluate.http_judge(f"http://127.0.0.1:{server.server_port}/chat", "k", "m", pause=0.001)
    rows = spark.createDataFrame([(f"q{k % 20}", "a", "b", "escalate") for k in range(25)] + [(None, "a", "b", "c")], "query_id string, query string, response string, decision string")
    path = str(tmp_path / "verdicts")
    with pytest.raises(RuntimeError, match="^1 rows have no verdict"):
        evaluate.judge_into(rows, path, ask, wave=6)
    assert sorted(calls) == sorted(f"q{k}" for k in range(20))
    broken.clear()
    calls.clear()
    found = evaluate.judge_into(rows.union(spark.createDataFrame([("new", "a", "b", "c")], rows.schema)), path, ask)
    assert sorted(calls) == ["new", "q7"]
    for _ in range(2):
        assert [(r.relevance, r.acceptable, r.grounding) for r in found.collect()] == [(4, False, None)] * 21
    assert len(calls) == 2
    server.shutdown()


def test_arrays_keep_every_row_in_order(spark, tmp_path):
    rows = spark.range(250).selectExpr("cast(249 - id as int) a", "if(id % 2 = 0, null, 'é') b").repartition(3)
    files.write_arrays(rows, str(tmp_path / "a"), [F.col("a").asc()], rows=40)
    arrays = sorted((json.loads(f.read_text()) for f in (tmp_path / "a").glob("part-*.txt")), key=lambda a: a[0]["a"])
    assert [r["a"] for a in arrays for r in a] == list(range(250)) and [len(a) for a in arrays] == [40] * 6 + [10] and all("b" in r for a in arrays for r in a)
    assert files.read_json_document(spark, str(tmp_path / "a"), "a int, b string").count() == 250


def test_incomplete_selections_may_be_short_but_not_over(spark):
    quotas = spark.createDataFrame([("b", "", 2)], "bucket string, intent string, quota long")
    rows = lambda *ids: spark.createDataFrame([(i, "b", "") for i in ids], "message_id string, bucket string, intent string")
    sampling.check_selection(rows("x"), quotas, complete=False)
    for bad, why in ((rows("x", "y", "z"), "differs"), (rows("x", "x"), "more than once")):
        with pytest.raises(ValueError, match=why):
            sampling.check_selection(bad, quotas, complete=False)


def retrieval_frames(spark, rows):
    """(queries, corpus) of (message_id, conversation_id, text, response)."""
    made = spark.createDataFrame(rows, "message_id string, conversation_id int, text string, response string")
    return made.withColumn("row", F.monotonically_increasing_id()).selectExpr("*", "'wifi' AS primary", "'primary_intent' AS bucket", "array(named_struct('intent_id', 'wifi')) AS matches", "'wifi' AS gold_intent")


def test_repeated_ids_keep_their_own_response(spark):
    """Of two messages with one id the one with the better response is chosen, and each query is there once a message."""
    corpus = retrieval_frames(spark, [("1", 1, "router wifi drops", None), ("2", 2, "router wifi drops", "thanks"), ("2", 2, "router wifi drops", "restart the wifi router in settings, go to settings and tap reset"), ("3", 3, "nothing alike", None)])
    texts = corpus.select("message_id", "conversation_id", "text")
    rows = retrieval.evidence(retrieval.results(corpus, retrieval.search(texts, texts), corpus))
    got = {(r.query_id, r.doc_id, r.generated_response) for r in retrieval.grounded(corpus, rows, corpus).collect()}
    assert ("1", "2", "restart the wifi router in settings, go to settings and tap reset") in got and ("3", None, None) in got
    assert retrieval.decide(retrieval.grounded(corpus, rows, corpus)).count() == 4


def test_evidence_shuffles_no_texts(spark):
    """Evidence and decisions without texts read words, told before the joins: no exchange behind them carries a text."""
    corpus = retrieval_frames(spark, [(str(k), k, f"router wifi drops {k % 3}", "restart the router") for k in range(9)])
    texts = corpus.select("message_id", "conversation_id", "text")
    rows = retrieval.results(corpus, retrieval.search(texts, texts), corpus)
    decided = retrieval.decide(retrieval.grounded(corpus, retrieval.evidence(rows), corpus)).select("query_id", "decision")
    plan = decided._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Project" in line and ("doc_words" in line or "query_words" in line or "unanswered" in line)]
    assert joins and not any(re.search(r"\b(query|doc_text|generated_response)#", line) for line in joins)


@pytest.mark.parametrize(("held", "asked"), [(69_201, 69_201), (400, 400), (1, 1), (1_000_000, 10), (10, 1_000_000)])
def test_blocks_copy_as_little_as_they_can(held, asked):
    across, down = retrieval._blocks(held, asked, 40_000, 10_000, 24)
    assert across * down >= 24 and held <= across * 40_000 and asked <= down * 10_000
    before = max(1, -(-held // 40_000))
    assert held * down + asked * across <= held * max(-(-asked // 10_000), -(-24 // before)) + asked * before
