"""Strict streams: one planted case for each rule, told alike in a batch and on a stream."""

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from verdigris.operators import strict as S
from verdigris.streaming import strict as stream


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def canonical(**x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


AT = "2024-01-01T00:00:00Z"


def profile(n, *steps):
    """A legal profile item: its candidate, then (decision, status) steps."""
    source = {"event_id": f"m{n}", "path": f"sessions/2024/s{n}/transcript.jsonl", "session_id": f"s{n}", "type": "session-user-message"}
    content = f'likes "{n}"\tand é'
    identity = canonical(source=source, category="goals", content=content)
    item, status, last = "profile-" + sha(identity), "candidate", "profile-event-" + sha("candidate\0" + identity)
    rest = {"schema_version": 1, "at": AT, "category": "goals", "evidence_type": "explicit-user-statement", "usage_scopes": ["discussion", "recommendation"], "sensitivity": "normal", "expires_at": None, "source": source}
    out = [rest | {"item": item, "event_id": last, "kind": "candidate", "from_status": None, "to_status": "candidate", "decision": None, "content": content, "content_sha256": sha(content), "user_statement": None, "decision_basis": "explicit-user-request"}]
    for k, (decision, to) in enumerate(steps):
        content = f"likes {n}.{k}" if decision == "revise" else content
        said = canonical(profile_item_id=item, previous_event_id=last, decision=decision, user_statement="yes", content=content)
        last = "profile-event-" + sha("decision\0" + said)
        out.append(rest | {"item": item, "event_id": last, "kind": "decision", "from_status": status, "to_status": to, "decision": decision, "content": content, "content_sha256": sha(content), "user_statement": " yes ", "decision_basis": "explicit-user-decision"})
        status = to
    return out


def belief(n, *steps):
    item, source, status, content = f"candidate-{n:04}", {"candidate_index": 1, "locator": None, "session_id": f"s{n}", "summary_path": "p"}, "candidate", f"holds {n}"
    rest = {"schema_version": 1, "at": AT, "belief_id": f"belief-{n:04}", "source": source, "item": item}
    out = [rest | {"event_id": "belief-event-" + sha("candidate-recorded\0" + item), "kind": "candidate", "from_status": None, "to_status": "candidate", "decision": None, "content": content, "content_sha256": sha(content), "user_statement": None, "decision_basis": "session-summary-candidate"}]
    for k, (decision, to) in enumerate(steps):
        content = f"holds {n}.{k}" if decision == "revise" else content
        said = canonical(candidate_id=item, from_status=status, decision=decision, user_statement="yes", content=content)
        out.append(rest | {"event_id": "belief-event-" + sha(said), "kind": "decision", "from_status": status, "to_status": to, "decision": decision, "content": content, "content_sha256": sha(content), "user_statement": "yes", "decision_basis": "explicit-user-decision"})
        status = to
    return out


CONFIRMED, REVISED = ("confirm", "confirmed"), ("revise", "revised")
#: Which event of a legal item is changed how, and what is told of it.
PROFILE_CASES = [
    (0, {"event_id": None}, "event-id-not-unique"), (0, {"schema_version": 2}, "schema"), (0, {"kind": "other"}, "schema"), (0, {"content": " "}, "content"), (0, {"content": "api_key: abcdefgh"}, "content"), (0, {"category": "other"}, "category"),
    (0, {"usage_scopes": []}, "usage-scopes"), (0, {"usage_scopes": ["recommendation", "discussion"]}, "usage-scopes"), (0, {"usage_scopes": None}, "usage-scopes"), (0, {"sensitivity": None}, "sensitivity"), (0, {"expires_at": "2024-01-01"}, "expiry"),
    (0, {"source": {"event_id": "m", "path": "/etc/x", "session_id": "s", "type": "session-user-message"}}, "source"), (0, {"source": None}, "source"), (0, {"decision_basis": "x"}, "decision-basis"), (0, {"at": "2024-01-01T00:00:00"}, "time"), (0, {"event_id": "e"}, "event-id-not-derived"),
    (0, {"content": "something else"}, "event-id-not-derived"), (0, {"from_status": "x"}, "transition"), (0, {"to_status": "confirmed"}, "transition"), (0, {"content_sha256": "0"}, "content-hash"), (0, {"evidence_type": "guess"}, "evidence"),
    (1, {"from_status": "revised"}, "transition"), (1, {"decision": "retire"}, "transition"), (1, {"to_status": "revised"}, "transition"), (1, {"content": None}, "content"), (1, {"user_statement": ""}, "statement"), (1, {"user_statement": "password: hunter22"}, "statement"), (1, {"decision_basis": None}, "decision-basis"),
    (1, {"content_sha256": "0"}, "content-hash"), (1, {"user_statement": "no"}, "event-id-not-derived"), (2, {"event_id": "x"}, "event-id-not-derived"), (2, {"at": "soon"}, "time"), (2, {"content": "other", "content_sha256": sha("other")}, "event-id-not-derived"),
]
BELIEF_CASES = [
    (0, {"event_id": ""}, "event-id-not-unique"), (0, {"schema_version": None}, "schema"), (0, {"belief_id": "belief-x"}, "belief-id"), (0, {"to_status": None}, "transition"), (0, {"content": None}, "content"), (0, {"content_sha256": "0"}, "content-hash"), (0, {"source": {"candidate_index": 0, "locator": None, "session_id": "s", "summary_path": "p"}}, "source"),
    (0, {"source": None}, "source"), (0, {"decision_basis": "x"}, "decision-basis"), (0, {"event_id": "x"}, "event-id-not-derived"), (0, {"at": None}, "time"), (1, {"belief_id": "b"}, "belief-id"), (1, {"from_status": None}, "transition"), (1, {"user_statement": " "}, "statement"), (1, {"content": ""}, "content"), (1, {"content_sha256": "0"}, "content-hash"),
    (1, {"decision_basis": "x"}, "decision-basis"), (1, {"source": {"candidate_index": 2, "locator": None, "session_id": "s", "summary_path": "p"}}, "source"), (1, {"to_status": "confirmed"}, "transition"), (1, {"content": "other", "content_sha256": sha("other")}, "content-changed"), (2, {"user_statement": "no"}, "event-id-not-derived"), (2, {"at": "x"}, "time"),
]


def log(kind):
    """All cases, legal items, a decision without its candidate, a second candidate, a repeated event and a step from a terminal status, in turns."""
    make, cases, steps = (profile, PROFILE_CASES, [CONFIRMED, REVISED]) if kind == "profile" else (belief, BELIEF_CASES, [("confirm", "provisional"), REVISED])
    items, want = [], []
    for n, (at, change, problem) in enumerate(cases):
        events = copy.deepcopy(make(n, *steps))
        events[at] |= change
        items.append(events)
        want.append((n, at, problem))
    n = len(items)
    more = make(n, *steps, REVISED, ("retire", "retired"))
    items += [more, make(n + 1)[:1], make(n + 2, *steps)[1:2], [*make(n + 3), *make(n + 3)], [*make(n + 4, *steps), make(n + 4, *steps)[1]], make(n + 5, ("reject", "rejected"), ("confirm", "confirmed"))]
    want += [(n + 2, 0, "decision-without-candidate"), (n + 3, 1, "event-id-not-unique"), (n + 4, 3, "event-id-not-unique"), (n + 5, 2, "transition")]
    rows, place, seq = [], {}, 0
    for k in range(max(map(len, items))):
        for i, events in enumerate(items):
            if k < len(events):
                place[i, k] = (events[k]["item"], seq)
                rows.append(events[k] | {"seq": seq})
                seq += 1
    return rows, {(*place[i, k], p) for i, k, p in want}


def frame(spark, kind, rows):
    schema = S.PROFILE_EVENTS if kind == "profile" else S.BELIEF_EVENTS
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


@pytest.mark.parametrize("kind", ["profile", "belief"])
def test_each_rule_has_its_case(spark, kind):
    rows, want = log(kind)
    found = {tuple(r) for r in S.violations(frame(spark, kind, rows), kind).collect()}
    firsts = {}
    for item, seq, problem in sorted(found, key=lambda x: x[1]):
        firsts.setdefault(item, (item, seq, problem))
    assert want <= found
    assert set(firsts.values()) == {min((w for w in want if w[0] == i), key=lambda w: w[1]) for i in {w[0] for w in want}}


@pytest.mark.parametrize("kind", ["profile", "belief"])
def test_a_stream_tells_what_a_batch_tells(spark, kind, tmp_path):
    rows, _ = log(kind)
    events = frame(spark, kind, rows)
    for i in range(3):  # an item's events come over several batches
        events.where((F.col("seq") >= len(rows) * i // 3) & (F.col("seq") < len(rows) * (i + 1) // 3)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    was, parts = spark.conf.get("spark.sql.streaming.stateStore.providerClass"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        incoming = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = stream.checked(incoming, kind).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    told = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(told.select("item", "seq", "problem")) == key(S.checked(S.with_previous(events), kind).select("item", "seq", "problem"))
    assert key(S.folded(told)) == key(S.states(events, kind))


def test_states(spark):
    rows, want = log("profile")
    refused = {w[0] for w in want}
    for r in S.states(frame(spark, "profile", rows), "profile").collect():
        assert r["refused"] == (r["item"] in refused) and (r["status"] is None) == r["refused"]
    legal = profile(len(PROFILE_CASES), CONFIRMED, REVISED, REVISED, ("retire", "retired"))
    (one,) = [r for r in S.states(frame(spark, "profile", rows), "profile").collect() if r["item"] == legal[0]["item"]]
    assert (one["status"], one["content"], one["event_id"], one["events"]) == ("retired", legal[-1]["content"], legal[-1]["event_id"], 5)


def test_the_lenient_reader_believes_what_it_reads(spark):
    rows = [r | {"seq": i} for i, r in enumerate([*belief(1, ("confirm", "provisional")), belief(2, ("confirm", "provisional"))[1], *belief(3), belief(3)[0] | {"content": "again"}])]
    rows[1]["to_status"] = ""
    rows[1]["content"] = "unchecked"
    got = sorted((r["item"], r["status"], r["content"]) for r in S.lenient_states(frame(spark, "belief", rows)).collect())
    assert got == [("candidate-0001", "candidate", "unchecked"), ("candidate-0003", "candidate", "again")]
