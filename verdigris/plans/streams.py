"""Queries over strict streams made of all events of all users, and over nested JSON made of conversations and documents, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import objects as O
from ..operators import documents as D
from ..operators import strict as S

_CLAIMS = ("Licensed under", "###")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _profiles(s: SparkSession, d: str) -> DataFrame:
    """A profile item for each user: its first event is the candidate, all others decisions of a legal life; some ids and hashes are damaged."""
    user = F.col("user_id")
    rows = _table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    source = F.struct(F.concat(F.lit("m"), user).alias("event_id"), F.concat(F.lit("sessions/2024/s"), user, F.lit("/transcript.jsonl")).alias("path"), F.concat(F.lit("s"), user).alias("session_id"), F.lit(S.SOURCE).alias("type"))
    rows = rows.withColumns({"source": source, "category": F.element_at(F.array(*map(F.lit, S.CATEGORIES)), (user % 8 + 1).cast("int")), "first": F.concat(F.col("e")[0]["event_type"], F.lit(" of "), user)})
    rows = rows.withColumn("identity", S.profile_identity(F.col("source"), F.col("category"), F.col("first"))).withColumn("item", F.concat(F.lit(S.PROFILE), F.sha2("identity", 256)))
    damaged = lambda k, id_: F.when(k % 223 == 0, F.concat(F.lit("e"), k)).otherwise(id_)

    def event(k, id_, kind, was, to, decision, content):
        return F.struct(k.alias("seq"), id_.alias("event_id"), F.lit(kind).alias("kind"), was.alias("from_status"), to.alias("to_status"), decision.alias("decision"), content.alias("content"))

    none = F.lit(None).cast("string")
    k0 = F.col("e")[0]["event_id"]
    start = event(k0, damaged(k0, F.concat(F.lit(S.PROFILE_EVENT), F.sha2(F.concat(F.lit("candidate\0"), "identity"), 256))), S.CANDIDATE, none, F.lit(S.CANDIDATE), none, F.col("first"))

    def then(done, x):
        last = F.element_at(done, -1)
        k, n = x["event_id"], F.size(done)
        ends = (n + 1 == F.size("e")) & (n > 1) & (k % 5 == 0)
        decision = F.when(ends, "retire").when((n == 1) & (k % 3 == 0), "confirm").otherwise("revise")
        to = F.when(ends, "retired").when((n == 1) & (k % 3 == 0), "confirmed").otherwise("revised")
        content = F.when(decision == "revise", F.concat(x["event_type"], F.lit(' "'), k.cast("string"), F.lit('"'))).otherwise(last["content"])
        id_ = S.profile_decision_id(F.col("item"), last["event_id"], decision, F.lit("ok"), content)
        return F.concat(done, F.array(event(k, damaged(k, id_), S.DECISION, last["to_status"], to, decision, content)))

    life = rows.select("item", "source", "category", F.explode(F.aggregate(F.slice("e", F.lit(2), F.size("e")), F.array(start), then)).alias("x")).select("item", "source", "category", "x.*")
    return life.select(
        "item", "seq", "event_id", F.lit(1).alias("schema_version"), "kind", F.lit("2024-01-01T00:00:00Z").alias("at"), "from_status", "to_status", "decision", "category", "content", F.when(F.col("seq") % 211 == 0, "bad").otherwise(F.sha2("content", 256)).alias("content_sha256"),
        F.lit(S.EVIDENCE).alias("evidence_type"), F.array(F.lit("discussion"), F.lit("recommendation")).alias("usage_scopes"), F.lit("normal").alias("sensitivity"), F.lit(None).cast("string").alias("expires_at"), "source", F.lit("ok").alias("user_statement"),
        F.when(F.col("kind") == S.CANDIDATE, S.CANDIDATE_BASES[1]).otherwise(S.DECISION_BASIS).alias("decision_basis"),
    )


def _objects(s: SparkSession, d: str) -> DataFrame:
    """Each turn as an object whose names come in no order, nested, with its own hash in it."""
    inner = F.struct(F.col("turn").alias("turn"), F.col("conv_id").alias("conv_id"))
    item = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.lit("x").alias("sha"), inner.alias("meta"), F.array(F.struct(F.lit(1).alias("b"), F.coalesce("role", F.lit("")).alias("a"))).alias("list")))
    rows = _table(s, d, "conversations").select("conv_id", "turn", item.alias("o"))
    return rows.select("conv_id", "turn", O.content_hash(F.col("o")).alias("whole"), O.object_hash(F.col("o"), "sha").alias("own"))


def _results(s: SparkSession, d: str) -> DataFrame:
    """Each document as a nested result: chapters as sections, paragraphs as claims that cite themselves."""
    paras = D.paragraphs(_table(s, d, "documents").select("doc_id", "text"))
    claims = paras.groupBy("doc_id", "chapter").agg(F.transform(F.sort_array(F.collect_list(F.struct("paragraph_index", "text", "locator"))), lambda x: F.struct(x["text"].alias("text"), F.array(x["locator"]).alias("citations"), F.lit(1).alias(_CLAIMS[0]))).alias("claims"))
    sections = claims.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chapter", "claims"))), lambda x: F.struct(x["claims"].alias("claims"))).alias("sections"))
    return sections.select("doc_id", F.to_json(F.struct("sections")).alias("result"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "profile_violations": lambda s, d: S.violations(_profiles(s, d), "profile"),
    "profile_states": lambda s, d: S.states(_profiles(s, d), "profile"),
    "profile_audit": lambda s, d: S.audit(_profiles(s, d), "profile"),
    "object_hashes": _objects,
    "cited_anywhere": lambda s, d: O.cited_anywhere(_results(s, d), "result", "doc_id"),
    "claimed_anywhere": lambda s, d: O.claimed_anywhere(_results(s, d), "result", list(_CLAIMS), "doc_id"),
}

_LIVES = """ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events),
life(user_id, n, seq, event_id, item, to_status, content) AS (
  SELECT user_id, n, event_id, CASE WHEN event_id % 223 = 0 THEN 'e' || event_id ELSE 'profile-event-' || sha256('candidate' || chr(0) || i) END, 'profile-' || sha256(i), 'candidate', event_type || ' of ' || user_id FROM (
    SELECT *, '{"category":"' || ['background', 'occupation', 'goals', 'interests', 'reading_preferences', 'communication_preferences', 'constraints', 'traits'][user_id % 8 + 1] || '","content":"' || event_type || ' of ' || user_id || '","source":{"event_id":"m' || user_id || '","path":"sessions/2024/s' || user_id || '/transcript.jsonl","session_id":"s' || user_id || '","type":"session-user-message"}}' AS i FROM ev WHERE n = 1)
  UNION ALL SELECT user_id, n, seq, CASE WHEN seq % 223 = 0 THEN 'e' || seq ELSE 'profile-event-' || sha256('decision' || chr(0) || '{"content":"' || replace(content, '"', '\\"') || '","decision":"' || decision || '","previous_event_id":"' || last || '","profile_item_id":"' || item || '","user_statement":"ok"}') END, item, to_status, content FROM (
    SELECT e.user_id, e.n, e.event_id AS seq, l.event_id AS last, l.item, CASE WHEN e.n = e.m AND e.n > 2 AND e.event_id % 5 = 0 THEN 'retire' WHEN e.n = 2 AND e.event_id % 3 = 0 THEN 'confirm' ELSE 'revise' END AS decision,
      CASE WHEN e.n = e.m AND e.n > 2 AND e.event_id % 5 = 0 THEN 'retired' WHEN e.n = 2 AND e.event_id % 3 = 0 THEN 'confirmed' ELSE 'revised' END AS to_status,
      CASE WHEN (e.n = e.m AND e.n > 2 AND e.event_id % 5 = 0) OR (e.n = 2 AND e.event_id % 3 = 0) THEN l.content ELSE e.event_type || ' "' || e.event_id || '"' END AS content FROM life l JOIN ev e ON e.user_id = l.user_id AND e.n = l.n + 1)),
vi AS (SELECT item, seq, CASE WHEN n = 1 AND seq % 223 = 0 THEN 'event-id-not-derived' WHEN seq % 211 = 0 THEN 'content-hash' WHEN seq % 223 = 0 THEN 'event-id-not-derived' END AS problem FROM life WHERE seq % 211 = 0 OR seq % 223 = 0)"""


def oracle(p: str) -> dict[str, str]:
    """The SQL, from the building block for paragraphs; lives of profile items are walked by recursion."""
    checks = ", ".join(f"('{c}')" for c in S.CHECKS["profile"])
    return {
        "profile_violations": f"WITH RECURSIVE {_LIVES} SELECT * FROM vi",
        "profile_states": f"WITH RECURSIVE {_LIVES}, st AS (SELECT item, item IN (SELECT item FROM vi) AS refused, arg_max(to_status, seq) AS a, arg_max(content, seq) AS b, arg_max(event_id, seq) AS c, count(*) AS events FROM life GROUP BY item) SELECT item, refused, CASE WHEN NOT refused THEN a END AS status, CASE WHEN NOT refused THEN b END AS content, CASE WHEN NOT refused THEN c END AS event_id, events FROM st",
        "profile_audit": f"WITH RECURSIVE {_LIVES} SELECT c AS \"check\", count(problem) AS violations, count(problem) = 0 AS ok FROM (VALUES {checks}) t(c) LEFT JOIN vi ON problem = c GROUP BY c",
        "object_hashes": """WITH o AS (SELECT conv_id, turn, '{"list":[{"a":' || CAST(to_json(coalesce(role, '')) AS VARCHAR) || ',"b":1}],"meta":{"conv_id":' || conv_id || ',"turn":' || turn || '},' AS a, '"text":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}' AS z FROM conversations) SELECT conv_id, turn, sha256(a || '"sha":"x",' || z) AS whole, sha256(a || z) AS own FROM o""",
        "cited_anywhere": f"WITH {p} SELECT doc_id, locator FROM p",
        "claimed_anywhere": f"WITH {p} SELECT doc_id, '$.sections[' || (chapter - 1) || '].claims[' || (paragraph_index - 1) || '].text' AS path, claim FROM p JOIN (VALUES ('Licensed under'), ('###')) c(claim) ON contains(text, claim)",
    }
