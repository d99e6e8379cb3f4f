"""End-to-end scoring: every status, failed calls, retries, rounding."""

import pytest
from pyspark.sql import functions as F

from veracity.operators import scoring
from veracity.operators.inference import complete
from veracity.plans.scorer import score
from veracity.sources.readers import KnowledgeSource


@pytest.fixture(scope="module")
def source(spark):
    docs = spark.createDataFrame([
        (1, "Alice", "Alice is a person. Alice likes tea."),
        (2, "Bob", "Bob is a builder. Bob met Alice in town."),
        (3, "Tea", "Tea is a drink. People drink tea."),
    ], "title_id bigint, title string, text string")
    vecs = spark.createDataFrame([
        (1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [1.0, 1.0]), (99, 1, [-5.0, -5.0]),
    ], "title_id bigint, cell int, embedding array<float>")
    gaz = spark.createDataFrame([("alice", 1), ("bob", 2), ("zed", 99)], "entity string, title_id bigint")
    return KnowledgeSource(docs, vecs).validate(), gaz


def gens(spark, rows):
    return spark.createDataFrame(rows, "gen_id bigint, model string, text string")


def by_gen(df):
    return {r.gen_id: r for r in df.collect()}


def test_statuses_offline(spark, source):
    src, gaz = source
    g = gens(spark, [
        (1, "m", "Alice met Bob. Alice likes tea."),
        (2, "m", "no names here at all."),
        (3, "m", ""),
        (4, "m", "Zed is here."),
    ])
    res = by_gen(score(g, src, gazetteer=gaz, k=1, exact=True).scores)
    assert res[1].status == "ok" and 0.0 <= res[1].score <= 1.0
    assert (res[2].status, res[2].score) == ("no_entities", 0.0)
    assert (res[3].status, res[3].score) == ("no_facts", 0.0)
    assert (res[4].status, res[4].score) == ("no_passages", 0.0)


class Answer:
    """Verification backend: fixed reply, optional failure for prompts containing a word."""

    def __init__(self, reply, fail_on=None, true_on=None):
        self.reply, self.fail_on, self.true_on = reply, fail_on, true_on

    def __call__(self, prompts):
        out = []
        for p in prompts:
            question = p.split("Question:")[-1]
            if self.fail_on and self.fail_on in question:
                raise RuntimeError("model unavailable")
            if self.true_on is not None:
                out.append("True" if self.true_on in question else "False")
            else:
                out.append({"content": self.reply, "cost": 0.5})
        return out


def test_all_undecided_is_null(spark, source):
    src, gaz = source
    g = gens(spark, [(1, "m", "Alice met Bob. Alice likes tea.")])
    res = by_gen(score(g, src, gazetteer=gaz, k=1, exact=True,
                       verify=Answer("cannot say"), call_opts={"retry_delay": 0.0}).scores)
    assert res[1].status == "undecided" and res[1].score is None
    assert res[1].cost == pytest.approx(1.0)   # two calls at 0.5


def test_failed_call_mid_batch_only_affects_its_fact(spark, source):
    src, gaz = source
    g = gens(spark, [(1, "m", "Alice met Bob. Alice likes tea. Bob is tall.")])
    out = score(g, src, gazetteer=gaz, k=1, exact=True,
                verify=Answer("True", fail_on="tea"), call_opts={"retry_delay": 0.0, "max_attempts": 2})
    dec = {r.fact: r.decision for r in out.decisions.collect()}
    assert dec == {"Alice met Bob.": True, "Alice likes tea.": None, "Bob is tall.": True}
    assert by_gen(out.scores)[1].score == 1.0


def test_one_of_32_rounds_half_even(spark, source):
    src, gaz = source
    text = " ".join(f"Alice said thing{i}." for i in range(32))
    g = gens(spark, [(1, "m", text)])
    out = score(g, src, gazetteer=gaz, k=1, exact=True,
                verify=Answer(None, true_on="thing7."), call_opts={"retry_delay": 0.0})
    r = by_gen(out.scores)[1]
    assert (r.status, r.score) == ("ok", 0.0312)


def test_extraction_failure(spark, source):
    src, gaz = source

    def extractor(prompts):
        return [RuntimeError("down") if "Bob" in p else "- Alice likes tea" for p in prompts]

    g = gens(spark, [(1, "m", "Alice likes tea."), (2, "m", "Bob met Alice.")])
    res = by_gen(score(g, src, gazetteer=gaz, k=1, exact=True, extract=extractor,
                       call_opts={"retry_delay": 0.0, "max_attempts": 2}).scores)
    assert res[1].status == "ok"
    assert (res[2].status, res[2].score, res[2].cost) == ("extraction_failed", 0.0, 0.0)


def test_retry_then_success(spark):
    class Flaky:
        def __init__(self):
            self.seen = {}

        def __call__(self, prompts):
            out = []
            for p in prompts:
                self.seen[p] = self.seen.get(p, 0) + 1
                out.append(RuntimeError("busy") if self.seen[p] < 3 else "True")
            return out

    reqs = spark.createDataFrame([(1, "a"), (2, "b")], "request_id bigint, prompt string").coalesce(1)
    ok = {r.request_id: r for r in complete(reqs, Flaky(), max_attempts=4, retry_delay=0.0).collect()}
    assert all(r.status == "ok" and r.attempts == 3 for r in ok.values())
    bad = {r.request_id: r for r in complete(reqs, Flaky(), max_attempts=2, retry_delay=0.0).collect()}
    assert all(r.status == "failed" and r.attempts == 2 and r.cost == 0.0 for r in bad.values())


def test_no_requests_no_calls(spark):
    def never(prompts):
        raise AssertionError("called")
    empty = spark.createDataFrame([], "request_id bigint, prompt string")
    assert complete(empty, never).count() == 0


def test_run_summary_counts_failures_as_zero(spark):
    s = spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("a", None, 3.0, 1.0), ("a", 0.0, 0.0, 0.0),
                               ("b", 0.5, 2.0, 0.2)],
                              "model string, score double, process_time double, cost double")
    r = {x.model: x for x in scoring.run_summary(s).collect()}
    assert (r["a"].mean_score, r["a"].mean_time, r["a"].mean_cost) == (0.3333, 1.3333, 0.6667)
    assert r["b"].mean_score == 0.5


def test_decisions_map_and_call_report(spark):
    d = spark.createDataFrame([(1, 0, True), (1, 1, None), (1, 2, False)], "gen_id bigint, fact_id int, decision boolean")
    f = spark.createDataFrame([(1, 0, "a."), (1, 1, "b."), (1, 2, "c.")], "gen_id bigint, fact_id int, fact string")
    m = scoring.decisions_map(d, f).first().decisions
    assert m == {"a.": True, "c.": False}
    calls = spark.createDataFrame([(1, "ok", 0.5), (2, "ok", None), (3, "failed", 9.0)],
                                  "gen_id bigint, status string, cost double")
    rep = {r.status: (r.n_calls, r.cost) for r in scoring.call_report(calls).collect()}
    assert rep == {"ok": (2, 0.5), "failed": (1, 0.0)}


class Count:
    """Completion backend that notes every call in a file."""

    def __init__(self, path, reply="True", bad=()):
        self.path, self.reply, self.bad = path, reply, bad

    def __call__(self, prompts):
        with open(self.path, "a") as f:
            f.write("".join("call\n" for _ in prompts))
        return [RuntimeError("down") if any(b in p for b in self.bad) else {"content": self.reply, "cost": 1.0} for p in prompts]

    def calls(self):
        import os
        return sum(1 for _ in open(self.path)) if os.path.exists(self.path) else 0


def test_resume_skips_answered_requests(spark, tmp_path):
    from veracity.operators.inference import persist_calls
    backend = Count(str(tmp_path / "log"), "reply")
    reqs = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "request_id bigint, prompt string")
    first = persist_calls(complete(reqs.where("request_id < 3"), backend), str(tmp_path / "calls"))
    assert first.count() == 3 and backend.calls() == 3
    again = persist_calls(complete(reqs, backend, done=first), str(tmp_path / "calls2"))
    assert sorted(r.request_id for r in again.collect()) == list(range(6)) and backend.calls() == 6


def test_score_resumes_from_an_earlier_run(spark, source, tmp_path):
    src, gaz = source
    g = gens(spark, [(1, "m", "Alice met Bob. Alice likes tea."), (2, "m", "Bob is tall.")])
    opts = dict(gazetteer=gaz, k=1, exact=True, call_opts={"retry_delay": 0.0, "max_attempts": 1})
    down = Count(str(tmp_path / "a"), bad=["Bob is tall"])
    one = score(g, src, verify=down, path=str(tmp_path / "run1"), **opts)
    assert by_gen(one.scores)[2].status == "undecided" and down.calls() == 3
    up = Count(str(tmp_path / "b"))
    two = score(g, src, verify=up, done=one.calls, path=str(tmp_path / "run2"), **opts)
    assert by_gen(two.scores)[2].score == 1.0 and by_gen(two.scores)[1].score == 1.0 and up.calls() == 1
    assert by_gen(two.scores)[1].cost == 2.0


def test_any_ids_and_slots(spark, source):
    """Generation ids over the whole range and more than 2^20 slots."""
    src, gaz = source
    ids = [2**43, -7 * 10**18, 2**63 - 1, 0]
    text = "- Alice met Bob\n- Alice likes tea"
    g = gens(spark, [(i, "m", "Alice.") for i in ids])
    out = score(g, src, gazetteer=gaz, k=1, exact=True, extract=Fixed(text), verify=Fixed("True"), call_opts={"retry_delay": 0.0})
    assert {i: (r.status, r.score) for i, r in by_gen(out.scores).items()} == {i: ("ok", 1.0) for i in ids}
    facts = spark.createDataFrame([(0, 0), (0, 2**21), (1, 0), (1, 2**20)], "gen_id bigint, fact_id int")
    calls = facts.withColumn("slot", scoring.slot_of(F.col("fact_id"))).select(
        "gen_id", "slot", F.lit("ok").alias("status"), F.when(F.col("fact_id") > 5, "False").otherwise("True").alias("content"))
    assert {(r.gen_id, r.fact_id): r.decision for r in scoring.decisions(facts, calls).collect()} == {
        (0, 0): True, (0, 2**21): False, (1, 0): True, (1, 2**20): False}


class Fixed:
    def __init__(self, reply):
        self.reply = reply

    def __call__(self, prompts):
        return [self.reply] * len(prompts)


def test_names_are_embedded_under_themselves(spark, source):
    """Vectors come back by the name, whatever its hash."""
    import dataclasses
    src, gaz = source
    src = dataclasses.replace(src, embed_fn=lambda texts: [[1.0, 0.0] if t == "alice" else [0.0, 1.0] for t in texts])
    out = score(gens(spark, [(1, "m", "Alice met Bob.")]), src, gazetteer=gaz.select("entity"), k=1, exact=True)
    assert by_gen(out.scores)[1].status == "ok" and {r.entity for r in out.calls["embed"].collect()} == {"alice", "bob"}


def test_one_bad_request_costs_no_time():
    import time

    from veracity.operators.inference import call_batch

    def backend(xs):
        if "bad" in xs:
            raise RuntimeError("poison")
        return [x.upper() for x in xs]

    items = [f"x{i}" for i in range(19)] + ["bad"]
    t = time.monotonic()
    got = call_batch(backend, items, "content", max_attempts=2, retry_delay=0.5)
    assert time.monotonic() - t < 1
    assert [c.value for c in got[:-1]] == [x.upper() for x in items[:-1]] and got[-1].error == "RuntimeError: poison" and got[-1].value is None
    once = call_batch(backend, items, "content", max_attempts=1, retry_delay=9)
    assert [c.error for c in once] == [None] * 19 + ["RuntimeError: poison"]


def test_short_and_empty_replies_fail():
    from veracity.operators.inference import call_batch
    short = call_batch(lambda xs: ["y"] if len(xs) == 1 and xs[0] == "a" else [], ["a", "b", "c"], "content", 1)
    assert [c.value for c in short] == ["y", None, None] and all("0 results for 1 requests" in c.error for c in short[1:])
    none = call_batch(lambda xs: [None for _ in xs], ["a"], "embedding", 2, 0.0)
    assert none[0].error == "reply without embedding" and none[0].attempts == 2
    paid = call_batch(lambda xs: [{"content": None, "cost": 2.0} for _ in xs], ["a"], "content", 3, 0.0)
    assert paid[0].cost == 6.0


def test_short_tagger_fails_its_facts_alone(spark):
    from veracity.operators.inference import tag_calls, tag_rows
    facts = spark.createDataFrame([(1, i, f"f{i}") for i in range(5)], "gen_id bigint, fact_id int, fact string").coalesce(1)
    calls = tag_calls(facts, lambda xs: [[("A", "PER")]] if xs == ["f3"] else [], max_attempts=1)
    assert {r.fact_id: r.status for r in calls.collect()} == {i: "ok" if i == 3 else "failed" for i in range(5)}
    assert [(r.fact_id, r.entity, r.label) for r in tag_rows(calls).collect()] == [(3, "A", "PER")]


def test_empty_source_is_rejected(spark, source):
    src, gaz = source
    with pytest.raises(ValueError):
        score(gens(spark, [(1, "m", "x")]), KnowledgeSource(src.docs.limit(0), src.vectors), gazetteer=gaz)


def test_names_of_any_length(spark):
    from veracity.operators.entities import gazetteer_entities
    facts = spark.createDataFrame([(1, 0, "Michael Collins met McDonald."), (1, 1, "Then Alice, who left."), (1, 2, "michael collins alice"),
                                   (1, 3, "(Jean-Luc de la Tour) spoke"), (1, 4, "")], "gen_id bigint, fact_id int, fact string")
    gaz = spark.createDataFrame([("michael collins",), ("mcdonald",), ("alice",), ("Collins",), ("Jean-Luc de la Tour",), ("",), ("...",)], "entity string")
    got = {(r.fact_id, r.entity) for r in gazetteer_entities(facts, gaz).collect()}
    assert got == {(0, "michael collins"), (0, "mcdonald"), (0, "Collins"), (1, "alice"), (3, "Jean-Luc de la Tour")}
    assert gazetteer_entities(facts, gaz.limit(0)).collect() == []


def test_entities_map_and_combine_runs(spark):
    from veracity.operators import entities
    facts = spark.createDataFrame([(1, 0, "Alice met Bob."), (1, 1, "Tea is hot.")],
                                  "gen_id bigint, fact_id int, fact string")
    tagged = spark.createDataFrame([(1, 0, "bob"), (1, 0, "alice")], "gen_id bigint, fact_id int, entity string")
    m = entities.entities_map(facts, tagged).first().fact_entities
    assert m == {"Alice met Bob.": ["alice", "bob"], "Tea is hot.": []}
    a = spark.createDataFrame([(1, 0.5)], "gen_id bigint, score double")
    b = spark.createDataFrame([(2, 1.0)], "gen_id bigint, score double")
    both = scoring.combine_runs({"gpt": a, "vicuna": b})
    assert sorted((r.model, r.gen_id) for r in both.collect()) == [("gpt", 1), ("vicuna", 2)]


def test_judge_compares_a_facts_tokens_in_place(spark):
    """Shares of distinct lower-cased tokens, facts given twice, without words or without texts included; no row is made for a token."""
    from veracity.operators import judge
    facts = [(1, 0, "The Cat sat"), (1, 1, "a b c d"), (1, 1, "x y"), (1, 2, None), (2, 0, "cat cat dog"), (2, 1, ""), (3, 0, "no texts"), (4, 0, "not shown")]
    texts = {(1, 0): "the cat", (1, 1): "A b. X", (1, 2): "c x Y", (2, 0): "DOG  end"}
    top = [(1, 0, 0), (1, 0, 2), (1, 1, 1), (1, 1, 2), (1, 2, 0), (2, 0, 0), (2, 1, 0), (3, 0, 5)]
    f = spark.createDataFrame(facts, "gen_id bigint, fact_id int, fact string")
    t = spark.createDataFrame(top, "gen_id bigint, fact_id int, pos bigint")
    p = spark.createDataFrame([(*k, v) for k, v in texts.items()], "gen_id bigint, pos bigint, text string")
    want = {}
    for g, i in {(g, i) for g, i, _ in top}:
        words = {w for a, b, pos in top if (a, b) == (g, i) for w in texts.get((g, pos), "\n").lower().split(" ")}
        own = [set(x.lower().split(" ")) for a, b, x in facts if (a, b) == (g, i) and x is not None]
        if own:
            want[g, i] = str(sum(len(o & words) for o in own) / sum(map(len, own)) >= 0.5)
    answers = judge.lexical_judge(f, t, p)
    assert {(r.gen_id, r.fact_id): r.answer for r in answers.collect()} == want and set(want.values()) == {"True", "False"}
    assert "Generate" not in answers._jdf.queryExecution().optimizedPlan().toString()
