"""Model stages: the answer log, retry rounds, and the limit on calls under way."""

import os
import time

import pytest

from veracity.operators.answers_log import AnswerLog
from veracity.operators.inference import call_rounds, complete, embed, tag_calls
from veracity.session import Store
from veracity.sources.fixtures import StubbornService

KEYS = ("request_id",)


class Noted:
    """Notes each prompt sent; the process dies once after ``dies_after`` prompts."""

    def __init__(self, folder, dies_after=None):
        self.folder, self.dies_after = str(folder), dies_after

    def __call__(self, prompts):
        with open(f"{self.folder}/sent", "a") as f:
            f.write("".join(f"{p}\n" for p in prompts))
        if self.dies_after is not None and not os.path.exists(f"{self.folder}/died") and len(self.sent()) > self.dies_after:
            open(f"{self.folder}/died", "w").close()
            os._exit(1)
        return [{"content": f"re {p}", "cost": 1.0} for p in prompts]

    def sent(self):
        return open(f"{self.folder}/sent").read().split("\n")[:-1] if os.path.exists(f"{self.folder}/sent") else []


def requests(spark, n, text="p"):
    return spark.createDataFrame([(i, f"{text}{i}") for i in range(n)], "request_id bigint, prompt string")


def replies(df):
    return {r.request_id: (r.status, r.content, r.attempts) for r in df.collect()}


def test_no_answer_is_paid_for_twice_after_a_lost_task(spark, tmp_path):
    """A worker dies in mid-stage; what runs again sends the requests without a logged answer only."""
    store, backend = Store(spark, str(tmp_path / "run")), Noted(tmp_path, dies_after=20)
    ask = lambda: call_rounds(complete, requests(spark, 40), backend, store, "calls", keys=KEYS, batch_size=4, max_under_way=1)
    with pytest.raises(Exception):
        ask()
    before = backend.sent()
    assert 20 < len(before) < 40
    got = replies(ask())
    assert got == {i: ("ok", f"re p{i}", 1) for i in range(40)}
    after = backend.sent()
    twice = {p for p in after if after.count(p) > 1}
    assert twice == set(before[-4:])  # the batch whose answer never came
    assert len(after) == 44


def test_a_finished_stage_is_not_asked_again(spark, tmp_path):
    store, backend = Store(spark, str(tmp_path / "run")), Noted(tmp_path)
    for _ in range(2):
        got = replies(call_rounds(complete, requests(spark, 10), backend, store, "calls", keys=KEYS))
        assert got == {i: ("ok", f"re p{i}", 1) for i in range(10)}
    assert len(backend.sent()) == 10
    # the same keys with other texts are other requests; fewer requests give fewer rows
    assert replies(call_rounds(complete, requests(spark, 3, "q"), backend, store, "calls", keys=KEYS)) == {i: ("ok", f"re q{i}", 1) for i in range(3)}
    assert len(backend.sent()) == 13


def test_rounds(spark):
    """Each request fails as often as its length modulo 6 says."""
    reqs = spark.createDataFrame([(i, "x" * i) for i in range(1, 40)], "request_id bigint, prompt string")
    store = Store(spark)
    got = {r.request_id: r for r in call_rounds(complete, reqs, StubbornService(), store, "calls", keys=KEYS, max_attempts=4, retry_delay=0.0).collect()}
    for i in range(1, 40):
        fails = i % 6
        assert got[i].attempts == min(fails + 1, 4) and got[i].status == ("ok" if fails < 4 else "failed")
        assert got[i].error == (None if fails < 4 else "RuntimeError: refused 4")
        assert got[i].cost == pytest.approx(i / 1000 if fails < 4 else 0.0)
    assert not store.has("calls_round1") and store.has("calls")
    # answers of an earlier run are returned, the failed ones asked again
    again = {r.request_id: r.status for r in call_rounds(complete, reqs, lambda ps: ["late"] * len(ps), Store(spark), "calls", keys=KEYS,
                                                         done=store.read("calls")).collect()}
    assert set(again) == set(got) and set(again.values()) == {"ok"}


def test_driver_waits_between_rounds(spark, monkeypatch):
    from veracity.operators import inference
    waits = []
    monkeypatch.setattr(inference, "pause", waits.append)
    call_rounds(complete, requests(spark, 2), lambda ps: [RuntimeError("no")] * len(ps), Store(spark), "calls", keys=KEYS, max_attempts=4, retry_delay=0.5)
    assert waits == [0.5, 1.0, 2.0]


class Busy:
    """Writes down when each call began and ended."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, prompts):
        began = time.time()
        time.sleep(0.02)
        with open(f"{self.folder}/{os.getpid()}-{began}", "w") as f:
            f.write(f"{began} {time.time()}")
        return ["ok"] * len(prompts)


@pytest.mark.parametrize("limit", [1, 3, 6])
def test_calls_under_way_are_bounded(spark, tmp_path, limit):
    call_rounds(complete, requests(spark, 60).repartition(20), Busy(tmp_path), Store(spark), "calls", keys=KEYS, batch_size=1, max_under_way=limit)
    spans = [tuple(map(float, open(tmp_path / f).read().split())) for f in os.listdir(tmp_path)]
    assert len(spans) == 60
    most = max(sum(a <= t < b for a, b in spans) for t, _ in spans)
    assert most <= limit and (limit == 1 or most > 1)


def test_vectors_and_tags_through_the_log(spark, tmp_path):
    store = Store(spark, str(tmp_path / "run"))
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "request_id bigint, text string")
    facts = spark.createDataFrame([(1, i, f"F {i}") for i in range(5)], "gen_id bigint, fact_id int, fact string")
    for n in range(2):  # the second time from the log: this backend would raise
        vec = lambda ts: [[1.0, 2.0] for _ in ts] if n == 0 else [RuntimeError("asked")] * len(ts)  # noqa: B023, E731
        tag = lambda fs: [[("F", "PER")] for _ in fs] if n == 0 else [RuntimeError("asked")] * len(fs)  # noqa: B023, E731
        v = call_rounds(embed, texts, vec, store, "v", keys=KEYS, max_attempts=1).collect()
        assert sorted((r.request_id, r.embedding) for r in v) == [(i, [1.0, 2.0]) for i in range(5)]
        t = call_rounds(tag_calls, facts, tag, store, "t", keys=("gen_id", "fact_id"), max_attempts=1).collect()
        assert sorted((r.fact_id, r.tags[0].entity, r.tags[0].label) for r in t) == [(i, "F", "PER") for i in range(5)]


def test_half_written_files_are_not_read(tmp_path):
    import pyarrow as pa
    log = AnswerLog(f"file://{tmp_path}/log", 2)
    assert log.answered(0) == []
    log.add(0, pa.table({"a": [1]}))
    (tmp_path / "log" / "of=2" / "part=0" / "x.tmp").write_bytes(b"half")
    assert [t.to_pydict() for t in log.answered(0)] == [{"a": [1]}] and log.answered(1) == []


def test_answers_of_an_attempt_go_to_one_file_and_requests_are_computed_once(spark, tmp_path):
    """Batches don't make a file each, and a retry round asks by the texts written down before, also where some failed requests have no text."""
    made = str(tmp_path / "made")

    def noted(batches):
        for pdf in batches:
            with open(made, "a") as f:
                f.write("x" * len(pdf))
            yield pdf

    rows = [(i, "x" * i if i else None) for i in range(60)]
    reqs = spark.createDataFrame(rows, "request_id bigint, prompt string").coalesce(1).mapInPandas(noted, "request_id bigint, prompt string")

    class Refuses:
        def attempt(self, n):
            return lambda prompts: [RuntimeError(f"refused {n}") if len(p or "") % 3 >= n or p is None and n < 3 else {"content": f"{p}", "cost": 1.0} for p in prompts]

    store = Store(spark, str(tmp_path / "run"))
    got = replies(call_rounds(complete, reqs, Refuses(), store, "calls", keys=KEYS, batch_size=4, max_under_way=1, max_attempts=4, retry_delay=0.0))
    assert got == {i: ("ok", f"{t}", 3 if t is None else i % 3 + 1) for i, t in rows}
    assert len(open(made).read()) == 60
    files = [f for _, _, names in os.walk(tmp_path / "run" / "calls_log") for f in names if not f.startswith(".")]
    assert len(files) == 3  # a round each


def test_a_log_that_was_cut_off_is_read_up_to_there(tmp_path):
    import pyarrow as pa
    log = AnswerLog(str(tmp_path / "log"), 1)
    with log.writer(0) as add:
        add(pa.table({"a": [1, 2]}))
        add(pa.table({"a": [3]}))
    with log.writer(0):
        pass  # an attempt without answers leaves no file
    [name] = os.listdir(tmp_path / "log" / "of=1" / "part=0")
    file = tmp_path / "log" / "of=1" / "part=0" / name
    assert [t.to_pydict() for t in log.answered(0)] == [{"a": [1, 2, 3]}]
    whole = file.read_bytes()
    file.write_bytes(whole[:-5])
    assert [t.to_pydict() for t in log.answered(0)] == [{"a": [1, 2]}]
    file.write_bytes(whole[:20])
    assert log.answered(0) == []
