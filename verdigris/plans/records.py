"""Queries over shelves, sessions, event streams, contexts and candidates made of the driver's tables, with their SQL.

The SQL is written from the semantics, with its own constants: it shares none with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as C
from ..operators import context as N
from ..operators import discovery as R
from ..operators import library as L
from ..operators import memory as M
from ..operators import sessions as S


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


# Shelves.
def _payloads(s: SparkSession, d: str) -> DataFrame:
    """A payload per nation: parts as books (some without an id, some with another's), suppliers as albums, every other nation with a collection."""
    key = F.col("p_partkey")
    item = F.when(key % 97 == 0, "").when((key % 89 == 5) & (key >= 25), (key - 25).cast("string")).otherwise(key.cast("string"))
    book = F.struct(key.alias("at"), item.alias("bookId"), F.when(key % 50 == 7, "").otherwise(F.concat_ws(" ", "p_name", key)).alias("title"), F.col("p_brand").alias("author"), (F.col("p_size") % 2).cast("string").alias("finishReading"), (F.col("p_size") > 40).cast("string").alias("isTop"), F.lit(None).cast("string").alias("secret"))
    books = _table(s, d, "part").groupBy((key % 25).cast("int").alias("shelf_id")).agg(F.sort_array(F.collect_list(book)).alias("books"))
    none = F.lit(None).cast("string")
    album = F.struct(F.col("s_suppkey").alias("at"), F.col("s_suppkey").cast("string").alias("albumId"), F.col("s_name").alias("name"), none.alias("authorName"), none.alias("finish"), none.alias("isTop"), none.alias("secret"))
    albums = _table(s, d, "supplier").groupBy((F.col("s_suppkey") % 25).cast("int").alias("shelf_id")).agg(F.sort_array(F.collect_list(album)).alias("albums"))
    mp = _table(s, d, "nation").select(F.col("n_nationkey").alias("shelf_id"), F.when(F.col("n_nationkey") % 2 == 0, F.struct(none.alias("title"))).alias("mp"))
    return mp.join(books, "shelf_id", "left").join(albums, "shelf_id", "left")


def _shelf(s: SparkSession, d: str) -> DataFrame:
    part = _table(s, d, "part").select(F.lit("book").alias("kind"), F.col("p_partkey").cast("string").alias("item_id"), F.concat_ws(" ", "p_name", "p_partkey").alias("title"), F.col("p_brand").alias("author"), F.col("p_partkey").alias("shelf_order"))
    supplier = _table(s, d, "supplier").select(F.lit("album").alias("kind"), F.col("s_suppkey").cast("string").alias("item_id"), F.col("s_name").alias("title"), F.lit("").alias("author"), (1_000_000_000 + F.col("s_suppkey")).alias("shelf_order"))
    return part.unionByName(supplier).withColumn("provider_identity", F.concat_ws(":", "kind", "item_id"))


def _locals(s: SparkSession, d: str) -> DataFrame:
    """Every third part as a local book, every sixtieth as a second one."""
    key, name = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_partkey")
    edition = F.when(F.col("p_size") < 10, "mismatch").when(F.col("p_size") < 30, "confirmed").otherwise("candidate").alias("edition_status")
    rest = [edition, F.when(F.col("p_size") % 2 == 0, "confirmed").otherwise("candidate").alias("mapping_status"), F.when(key % 21 == 0, "error").otherwise("text-ready").alias("text_status"), _pick(("not-started", "partial", "discussion-ready"), F.col("p_size") % 3).alias("analysis_status")]
    first = _table(s, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("L"), key).alias("stable_id"), F.when(key % 9 == 0, F.concat(F.upper(name), F.lit(": notes"))).otherwise(name).alias("title"), F.array(F.when(key % 15 == 0, "nobody").otherwise(F.col("p_brand"))).alias("authors"), F.when(key % 6 == 0, key.cast("string")).alias("provider_id"), *rest)
    second = _table(s, d, "part").where("p_partkey % 60 = 0").select(F.concat(F.lit("M"), key).alias("stable_id"), name.alias("title"), F.array("p_brand").alias("authors"), F.when(key % 120 == 0, key.cast("string")).alias("provider_id"), *rest)
    return first.unionByName(second)


def _greedy(s: SparkSession, d: str) -> DataFrame:
    """Eight parts are a saga: shelf entries of its whole title or of one volume, by Frank, by Junior or by both; locals of some volumes, a few in error or claimed by an entry further on."""
    key = F.col("p_partkey")
    saga, k, w = F.floor(key / 8), key % 8, F.col("p_size") % 5
    volume = lambda n: F.concat(F.lit("Saga "), saga, F.lit(": Vol. "), n)
    shelf = _table(s, d, "part").select(F.lit("book").alias("kind"), key.cast("string").alias("item_id"), F.when(w < 3, F.concat(F.lit("SAGA-"), saga)).otherwise(volume(k % 3)).alias("title"), _pick(("Frank Junior", "Frank", "Junior", "Frank Junior", "Nobody"), F.floor(F.col("p_size") / 5) % 5).alias("author"), key.alias("shelf_order"))
    local = _table(s, d, "part").where("p_partkey % 8 in (1, 2, 5, 6)").select(
        F.concat(F.lit("L"), key).alias("stable_id"), F.when(k == 6, F.concat(F.lit("Saga "), saga)).otherwise(volume(k % 3)).alias("title"), F.array(_pick(("Frank", "Junior"), F.col("p_size") % 2)).alias("authors"),
        F.when(F.col("p_size") % 7 == 0, (key + 1).cast("string")).alias("provider_id"), F.when(F.col("p_size") % 11 == 0, "error").otherwise("text-ready").alias("text_status"),
    )
    return L.candidate_links(shelf, local, L.direct_links(shelf, local))


def _overview(s: SparkSession, d: str) -> DataFrame:
    return L.overview(_shelf(s, d), _locals(s, d))


_ENTRIES = """raw AS (SELECT CAST(p_partkey % 25 AS INTEGER) AS shelf_id, 'book' AS kind, CASE WHEN p_partkey % 97 = 0 THEN '' WHEN p_partkey % 89 = 5 AND p_partkey >= 25 THEN CAST(p_partkey - 25 AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS item_id,
  CASE WHEN p_partkey % 50 = 7 THEN '未命名书籍' ELSE p_name || ' ' || p_partkey END AS title, p_brand AS author, p_size % 2 = 1 AS finish_reading, p_size > 40 AS is_top, false AS is_private, 0 AS t, p_partkey AS at_ FROM part
UNION ALL SELECT CAST(s_suppkey % 25 AS INTEGER), 'album', CAST(s_suppkey AS VARCHAR), s_name, '', false, false, false, 1, s_suppkey FROM supplier
UNION ALL SELECT n_nationkey, 'mp', 'collection', '文章收藏', '', false, false, true, 2, 0 FROM nation WHERE n_nationkey % 2 = 0),
entries AS (SELECT shelf_id, kind, CASE WHEN item_id <> '' THEN kind || ':' || item_id END AS provider_identity, item_id, title, author, finish_reading, is_top, is_private, CAST(row_number() OVER (PARTITION BY shelf_id ORDER BY t, at_) AS INTEGER) AS shelf_order FROM raw)"""
_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_OVERVIEW = f"""shelf AS (SELECT 'book' AS kind, CAST(p_partkey AS VARCHAR) AS item_id, {_KEY.format("p_name || p_partkey")} AS key, {_KEY.format("p_brand")} AS author, p_partkey AS shelf_order FROM part
  UNION ALL SELECT 'album', CAST(s_suppkey AS VARCHAR), {_KEY.format("s_name")}, '', 1000000000 + s_suppkey FROM supplier),
loc AS (SELECT 'L' || p_partkey AS stable_id, p_partkey, {_KEY.format("p_name || p_partkey")} AS base, p_partkey % 9 <> 0 AS whole, CASE WHEN p_partkey % 15 = 0 THEN 'nobody' ELSE {_KEY.format("p_brand")} END AS author, CASE WHEN p_partkey % 6 = 0 THEN CAST(p_partkey AS VARCHAR) END AS provider_id, p_size FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'M' || p_partkey, p_partkey, {_KEY.format("p_name || p_partkey")}, true, {_KEY.format("p_brand")}, CASE WHEN p_partkey % 120 = 0 THEN CAST(p_partkey AS VARCHAR) END, p_size FROM part WHERE p_partkey % 60 = 0),
local AS (SELECT stable_id, base, whole, author, provider_id, CASE WHEN p_size < 10 THEN 'mismatch' WHEN p_size < 30 THEN 'confirmed' ELSE 'candidate' END AS edition, CASE WHEN p_size % 2 = 0 THEN 'confirmed' ELSE 'candidate' END AS mapping,
  CASE WHEN p_partkey % 21 = 0 THEN 'error' ELSE 'text-ready' END AS text, CASE p_size % 3 WHEN 0 THEN 'not-started' WHEN 1 THEN 'partial' ELSE 'discussion-ready' END AS analysis FROM loc),
claims AS (SELECT provider_id, min(stable_id) AS stable_id, count(DISTINCT stable_id) AS n FROM local WHERE provider_id IS NOT NULL GROUP BY provider_id),
direct AS (SELECT item_id, stable_id FROM shelf JOIN claims ON item_id = provider_id AND kind = 'book' AND n = 1),
pairs AS (SELECT s.item_id, s.shelf_order, l.stable_id, l.whole FROM shelf s JOIN local l ON s.key = l.base AND s.kind = 'book' AND l.text <> 'error' AND (contains(s.author, l.author) OR contains(l.author, s.author))
  WHERE l.stable_id NOT IN (SELECT stable_id FROM direct) AND s.item_id NOT IN (SELECT item_id FROM direct)),
cand AS (SELECT * FROM (SELECT item_id, min(stable_id) AS stable_id, bool_or(whole) AS whole, row_number() OVER (PARTITION BY min(stable_id) ORDER BY min(shelf_order), item_id) AS n FROM pairs GROUP BY item_id HAVING min(stable_id) = max(stable_id)) WHERE n = 1),
links AS (SELECT item_id, stable_id, 'provider-id' AS basis FROM direct UNION ALL SELECT item_id, stable_id, CASE WHEN whole THEN 'exact-title-author' ELSE 'base-title-author' END FROM cand),
rows_ AS (SELECT kind || ':' || s.item_id AS provider_identity, kind, k.stable_id, basis, edition, mapping, text, analysis FROM shelf s LEFT JOIN links k ON s.item_id = k.item_id AND kind = 'book' LEFT JOIN local l ON k.stable_id = l.stable_id
  UNION ALL SELECT NULL, 'book', stable_id, NULL, edition, mapping, text, analysis FROM local WHERE stable_id NOT IN (SELECT stable_id FROM links)),
linked AS (SELECT *, CASE WHEN kind <> 'book' THEN 'not-applicable' WHEN stable_id IS NULL THEN 'unlinked' WHEN provider_identity IS NULL THEN 'local-only' WHEN edition = 'mismatch' THEN 'mismatch' WHEN edition = 'confirmed' AND mapping = 'confirmed' AND basis = 'provider-id' THEN 'confirmed' ELSE 'needs-confirmation' END AS link_status FROM rows_),
told AS (SELECT provider_identity, kind, stable_id, basis, link_status, CASE WHEN kind <> 'book' THEN 'not-applicable' WHEN stable_id IS NULL THEN 'source-missing' WHEN link_status = 'needs-confirmation' THEN 'needs-confirmation' ELSE text END AS text_status, analysis AS analysis_status, text AS local_text_status,
  coalesce(link_status = 'confirmed' AND text = 'text-ready' AND analysis = 'discussion-ready', false) AS discussion_available FROM linked),
overview AS (SELECT *, CASE WHEN kind <> 'book' THEN 'register-only' WHEN local_text_status = 'error' THEN 'repair-local' WHEN link_status = 'needs-confirmation' THEN 'confirm-edition' WHEN link_status = 'mismatch' THEN 'review-mismatch' WHEN text_status = 'source-missing' THEN 'import-source'
  WHEN analysis_status IN ('not-started', 'partial', 'failed') THEN 'analyse' WHEN discussion_available THEN 'discuss' WHEN link_status = 'local-only' THEN 'await-link' ELSE 'keep' END AS next_action FROM told)"""


_GREEDY = """rem AS (SELECT p_partkey // 8 AS c, p_partkey % 8 AS k, CAST(p_partkey AS VARCHAR) AS item, CASE WHEN p_size % 5 < 3 THEN 'saga' || (p_partkey // 8) ELSE 'saga' || (p_partkey // 8) || 'vol' || (p_partkey % 8 % 3) END AS t, ['frankjunior', 'frank', 'junior', 'frankjunior', 'nobody'][p_size // 5 % 5 + 1] AS a FROM part),
loc AS (SELECT p_partkey // 8 AS c, 'L' || p_partkey AS sid, 'saga' || (p_partkey // 8) AS base, CASE WHEN p_partkey % 8 = 6 THEN 'saga' || (p_partkey // 8) ELSE 'saga' || (p_partkey // 8) || 'vol' || (p_partkey % 8 % 3) END AS whole, ['frank', 'junior'][p_size % 2 + 1] AS a, CASE WHEN p_size % 7 = 0 THEN CAST(p_partkey + 1 AS VARCHAR) END AS claim, p_size % 11 = 0 AS bad FROM part WHERE p_partkey % 8 IN (1, 2, 5, 6)),
m AS (SELECT r.c, r.k, r.item, any_value(d.sid) AS direct, list({'sid': l.sid, 'whole': l.whole = r.t}) FILTER (l.sid IS NOT NULL) AS fits FROM rem r LEFT JOIN loc d ON d.claim = r.item LEFT JOIN loc l ON l.c = r.c AND NOT l.bad AND (l.whole = r.t OR l.base = r.t) AND (contains(r.a, l.a) OR contains(l.a, r.a)) GROUP BY ALL),
walk(c, k, item, got, used, direct) AS (
  SELECT DISTINCT c, -1::BIGINT, NULL::VARCHAR, NULL::STRUCT(sid VARCHAR, whole BOOLEAN), []::VARCHAR[], NULL::VARCHAR FROM rem
  UNION ALL SELECT c, k, item, got, CASE WHEN direct IS NOT NULL THEN list_append(used, direct) WHEN got IS NOT NULL THEN list_append(used, got.sid) ELSE used END, direct FROM (
    SELECT w.c, w.k + 1 AS k, m.item, m.direct, w.used, CASE WHEN m.direct IS NULL AND len(list_filter(m.fits, lambda x: NOT list_contains(w.used, x.sid))) = 1 THEN list_filter(m.fits, lambda x: NOT list_contains(w.used, x.sid))[1] END AS got FROM walk w LEFT JOIN m ON m.c = w.c AND m.k = w.k + 1 WHERE w.k < 7))"""


# Sessions, notes and weeks.
def _sessions(s: SparkSession, d: str) -> DataFrame:
    conv = _table(s, d, "conversations").select("conv_id").distinct()
    start = F.timestamp_add("HOUR", (F.col("conv_id") * 7).cast("int"), F.to_timestamp(F.lit("2023-12-30 00:00:00")))
    return conv.select(F.col("conv_id").alias("session_id"), start.alias("started_at"), F.when(F.col("conv_id") % 5 != 0, F.timestamp_add("HOUR", F.lit(1), start)).alias("ended_at"), _pick(("draft", "generated", "confirmed"), F.col("conv_id") % 3).alias("summary_status"))


def _transcript(s: SparkSession, d: str) -> DataFrame:
    kind = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 0), "discussion-skipped-by-user").when(F.col("turn") % 4 == 3, "note").otherwise("message")
    return _table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("event_id"), "role", kind.alias("event_type"))


def _records(s: SparkSession, d: str) -> DataFrame:
    return S.session_records(_sessions(s, d), _transcript(s, d))


def _summaries(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    item = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, ("text", "claim", "locator", "source"), strict=True)])
    c = F.col("conv_id").cast("string")
    explicit = F.array(item(F.concat(F.lit("a"), c), none, none, none), item(F.lit(""), F.concat(F.lit("c"), c), F.lit(""), F.lit("s")), item(none, none, F.lit("l"), none))
    sources = F.array(item(F.lit("x"), none, F.concat(F.lit("loc"), c), none), item(F.lit("y"), none, none, none), item(F.lit("z"), none, F.lit(""), F.concat(F.lit("src"), c)))
    return _table(s, d, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("session_id"), F.array((F.col("conv_id") % 25).cast("string"), F.concat(F.lit("x"), F.col("conv_id") % 3)).alias("book_ids"), explicit.alias("author_explicit"), sources.alias("sources"), F.when(F.col("conv_id") % 4 == 1, F.array(F.lit("q"))).alias("unresolved"), F.array_repeat(F.lit("p"), (F.col("conv_id") % 6).cast("int")).alias("profile_candidates"))


def _flat(s: SparkSession, d: str) -> DataFrame:
    rows = S.flattened(_summaries(s, d), "author_explicit", _table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("book_id"), F.col("n_name").alias("title")))
    return rows.withColumns({"books": F.array_join("books", "|"), "evidence": F.array_join("evidence", "|")})


def _notes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rows = _table(s, d, "events").where("event_type = 'click'").select("event_id", F.when(k == 0, F.unix_timestamp("ts")).when(k == 1, F.lit(0)).cast("bigint").alias("create_time"), F.when(k == 1, F.concat(text, F.lit("Z"))).when(k == 2, text).alias("synced_at"))
    return S.dated_notes(rows)


def _catalog(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "events").where("event_type = 'signup'").select(F.when(F.col("event_id") % 2 == 0, "book-imported").otherwise("status-changed").alias("event"), F.col("ts").alias("at"))


def _insights(s: SparkSession, d: str) -> DataFrame:
    rows = _table(s, d, "conversations").where("role = 'user'")
    return S.insight_candidates(rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), F.when(F.col("turn") % 9 == 8, "无").otherwise(F.col("text")).alias("text")))


def _marks(s: SparkSession, d: str) -> DataFrame:
    rows = _table(s, d, "events").where("event_type = 'view'")
    marks = rows.select(F.col("user_id").alias("book_id"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_id").cast("string")).alias("bookmarkId"), (F.col("event_id") % 7).alias("chapterUid"), F.col("props").alias("markText"), F.concat_ws("-", "event_id", F.col("event_id") + 9).alias("range"), F.col("event_id").alias("createTime"))
    chapters = rows.select(F.col("user_id").alias("book_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("chapterUid")).distinct().withColumns({"chapterIdx": (F.col("chapterUid") + 1).cast("int"), "title": F.concat(F.lit("Chapter "), F.col("chapterUid") + 1)})
    return S.note_events(marks, chapters)


_SESS = """sess AS (SELECT DISTINCT conv_id AS session_id, TIMESTAMP '2023-12-30' + to_hours(CAST(conv_id * 7 AS INTEGER)) AS started_at FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 3 <> 0),
rec AS (SELECT session_id, started_at, CASE WHEN bool_or(conv_id % 7 = 0 AND turn = 0) THEN 'skipped-by-user' ELSE 'completed' END AS status FROM sess JOIN conversations ON conv_id = session_id GROUP BY ALL)"""
_NOTES = """notes AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN 1 THEN 0 END AS create_time, CASE event_id % 3 WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS synced_at, date_trunc('second', ts) AS occurred_at FROM events WHERE event_type = 'click' AND event_id % 3 <> 2)"""
_INS = """ins AS (SELECT conv_id AS session_id, turn + 1 AS n, trim(CASE WHEN turn % 9 = 8 THEN '无' ELSE text END) AS content FROM conversations WHERE role = 'user'),
cands AS (SELECT 'candidate-' || substring(sha256(session_id || chr(0) || n || chr(0) || content), 1, 16) AS candidate_id, session_id, content FROM ins WHERE content <> '' AND content <> '无')"""


# Event streams.
def _stream(s: SparkSession, d: str) -> DataFrame:
    """A candidate and decisions for each user, of all events: those of every third user legal, those of others out of order or damaged."""
    from pyspark.sql import Window

    rows = _table(s, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    start, legal = F.col("n") == 1, F.col("user_id") % 3 == 0
    k = F.when(legal, 1).otherwise(F.col("event_id") % 4)
    was = F.when(start, F.lit(None).cast("string")).when(F.col("n") == 2, "candidate").otherwise(_pick(("confirmed", "revised"), F.when(legal, 1).otherwise(F.col("event_id") % 2)))
    decision = F.when(~start, _pick(("confirm", "revise", "reject", "retire"), k))
    to = F.when(start, "candidate").otherwise(_pick(("confirmed", "revised", "rejected", "retired"), k))
    return rows.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.concat(F.lit("e"), "event_id").alias("event_id"), F.when(start, "candidate").otherwise("decision").alias("kind"), decision.alias("decision"), was.alias("from_status"), to.alias("to_status"), F.col("event_type").alias("content"), F.when(~legal & (F.col("event_id") % 11 == 0), "bad").otherwise(F.sha2("event_type", 256)).alias("content_sha256"))


def _requests(s: SparkSession, d: str) -> DataFrame:
    rows = _table(s, d, "conversations").where("role = 'user'")
    return rows.select(F.when(F.col("turn") % 2 == 0, "goal").otherwise("habit").alias("category"), F.coalesce("text", F.lit("")).alias("content"), F.col("conv_id").cast("string").alias("source"), F.when(F.col("turn") % 3 != 0, "remember this").alias("statement"))


def _stored(s: SparkSession, d: str) -> DataFrame:
    r = _requests(s, d)
    return M.recorded(r.where(F.col("source").cast("int") % 2 == 0), r.select(F.lit("none").alias("event_id")))


def _current(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    return _table(s, d, "customer").select(F.col("c_custkey").alias("item"), _pick(("candidate", "confirmed", "revised", "rejected", "retired"), k).alias("status"), F.col("c_mktsegment").alias("content"), F.concat(F.lit("e"), "c_custkey").alias("event_id"), F.when(k == 1, "confirm").alias("last_decision"), F.when(k == 1, "ok").alias("last_statement"))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "customer").select(F.col("c_custkey").alias("item"), _pick(("confirm", "revise", "reject", "retire"), F.col("c_nationkey") % 4).alias("decision"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise("ok").alias("statement"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("revised"))


def _settings(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "off").when(F.col("o_orderstatus") == "O", "proactive-review").otherwise("explicit-only").alias("mode"))


def _beliefs(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    content = F.when(k % 11 == 0, " ").when(k % 13 == 0, "my Password is here").when(k % 17 == 0, F.lit(None)).otherwise(F.col("c_name"))
    return M.belief_sources(_table(s, d, "customer").select(k.cast("string").alias("item"), _pick(("candidate", "provisional", "confirmed", "revised", "rejected", "retired"), k % 6).alias("status"), content.alias("content")))


def _tasks(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("seq"), _pick(("context-review", "evidence-ready", "report-ready", "completed", "failed"), F.col("o_orderkey") % 5).alias("event"))


# Contexts.
def _sources(s: SparkSession, d: str) -> DataFrame:
    now = N.current_sources(_table(s, d, "nation").select(F.lit("t").alias("task"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("content")))
    history = N.history_sources(C.user_statements(_table(s, d, "conversations")))
    return N.assembled([now, history, _beliefs(s, d).withColumn("source_type", F.lit("belief"))])


def _choices(s: SparkSession, d: str) -> DataFrame:
    who = _table(s, d, "customer").select("c_custkey")
    choice = lambda n, c: who.where(f"c_custkey % {n} = 0").select(F.concat(F.lit("belief:"), F.col("c_custkey").cast("string")).alias("source_id"), F.lit(c).alias("choice"))
    return choice(10, "include").unionByName(choice(15, "exclude"))


def _packet(s: SparkSession, d: str) -> DataFrame:
    return N.frozen(N.selected(_sources(s, d), _choices(s, d)).join(_sources(s, d).select("source_id", "content"), "source_id"))


def _frozen_problems(s: SparkSession, d: str) -> DataFrame:
    """The packet was stored before some sources changed, went, or were chosen."""
    now = _sources(s, d).withColumn("content", F.when(F.col("source_id").like("%7"), "changed").otherwise(F.col("content"))).where("source_id not like '%3'")
    stored = _packet(s, d).withColumn("basis", F.when(F.col("source_id").like("%0"), "confirmed-default").otherwise(F.col("basis")))
    return N.frozen_problems(stored, now)


def _reviewed(s: SparkSession, d: str) -> DataFrame:
    before = _beliefs(s, d).where("source_id like '%5'").select("source_id", F.lit("explicit-user-context-confirmation").alias("basis"))
    return N.reviewed(before, _sources(s, d), _choices(s, d))


_SRC = r"""stm AS (SELECT 'session:' || conv_id || '-' || turn || ':' || i AS source_id, trim(line) AS content FROM (SELECT conv_id, turn, generate_subscripts(regexp_split_to_array(text, '[\r\n]+'), 1) AS i, unnest(regexp_split_to_array(text, '[\r\n]+')) AS line FROM conversations WHERE role = 'user') WHERE trim(line) <> ''
  AND NOT regexp_matches(line, '(?i)(api[ _-]?key|access[ _-]?token|authorization|credential|secret|password|密钥|密码|令牌)') AND NOT regexp_matches(line, '(?i)(验收|体验可用|节点\s*\d|跳过.{0,6}讨论|流程.{0,8}通过|skill|同步.{0,8}成功|导入.{0,8}成功)')),
bel AS (SELECT 'belief:' || c_custkey AS source_id, c_custkey % 6 AS st, trim(CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 13 = 0 THEN 'my Password is here' WHEN c_custkey % 17 = 0 THEN '' ELSE c_name END) AS c FROM customer),
bel1 AS (SELECT source_id, CASE WHEN c <> '' AND NOT contains(lower(c), 'password') THEN c END AS content, CASE WHEN c = '' OR contains(lower(c), 'password') THEN 'belief-content-not-safe' WHEN st > 3 THEN 'belief-status-not-usable' END AS exclusion_basis, st IN (2, 3) AS d, st IN (0, 1) AS x FROM bel),
src AS (SELECT 'current:t:' || n_nationkey AS source_id, 'current-request' AS source_type, n_name AS content, CAST(NULL AS VARCHAR) AS exclusion_basis, true AS selected_by_default, false AS requires_explicit_selection FROM nation
  UNION ALL SELECT source_id, 'historical-statement', content, NULL, false, true FROM stm UNION ALL SELECT source_id, 'belief', content, exclusion_basis, exclusion_basis IS NULL AND d, exclusion_basis IS NULL AND x FROM bel1)"""
_CHO = "cho AS (SELECT 'belief:' || c_custkey AS source_id, c_custkey % 10 = 0 AS inc, c_custkey % 15 = 0 AS exc FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 15 = 0)"
_SEL = f"""{_SRC}, {_CHO}, sel AS (SELECT src.*, CASE WHEN exc THEN 'excluded' WHEN inc THEN 'explicit-user-context-confirmation' WHEN selected_by_default THEN 'confirmed-default' END AS basis FROM src LEFT JOIN cho USING (source_id) WHERE exclusion_basis IS NULL)"""


# Candidates.
def _feeds(s: SparkSession, d: str) -> DataFrame:
    """Three feeds of three shapes: parts flat, in ``bookInfo`` (with the outer author winning), and in ``book.bookInfo``."""
    p = _table(s, d, "part")
    key = F.col("p_partkey")
    info = F.struct(key.cast("string").alias("bookId"), F.when(key % 31 == 0, " ").otherwise(F.concat_ws(" ", "p_name", key)).alias("title"), F.when(key % 4 == 0, "").otherwise(F.col("p_brand")).alias("author"), (F.col("p_size") * 10).alias("newRatingCount"), F.when(key % 9 == 0, "yes").otherwise("0").alias("soldout"))
    rows = lambda shape, where: p.where(where).select(F.to_json(shape).alias("raw"), key.alias("position"))
    return R.feed_union({
        "a-feed": rows(info, "p_partkey % 2 = 0"), "b-similar": rows(F.struct(info.alias("bookInfo"), F.col("p_type").alias("author"), F.lit("like").alias("reason")), "p_partkey % 3 = 0"),
        "c-search": rows(F.struct(F.struct(info.alias("bookInfo")).alias("book"), F.lit("novel").alias("category")), "p_partkey % 5 = 0"),
    })


def _found(s: SparkSession, d: str) -> DataFrame:
    return R.merged(R.candidates(_feeds(s, d)))


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "part").where("p_partkey % 7 = 0").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).alias("item_id"), F.concat_ws("-", F.upper("p_name"), "p_partkey").alias("title"), F.col("p_type").alias("author"), F.concat(F.lit("L"), "p_partkey").alias("stable_id"), F.col("p_partkey").alias("shelf_order"))


def _query_problems(s: SparkSession, d: str) -> DataFrame:
    said = C.user_statements(_table(s, d, "conversations"))
    k = F.col("turn") % 5
    lines = F.when(k == 0, F.split(F.coalesce("text", F.lit("")), "\n")).when(k == 1, F.array(F.lit("books on skill"))).when(k == 2, F.array(F.lit(""))).when(k == 3, F.array(F.repeat(F.lit("long "), 20))).otherwise(F.array(F.lit("novels of the sea")))
    rows = _table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(lines).alias("line", "query")).select(F.concat_ws("-", "conv_id", "turn", "line").alias("query_id"), "query")
    return R.query_problems(rows, said)


def _results(s: SparkSession, d: str) -> DataFrame:
    found = R.candidates(_feeds(s, d)).groupBy("candidate_id").agg(F.min("source_id").alias("source_id"), F.min("position").alias("k"))
    return found.select(
        F.col("k").alias("item"), _pick(("deepen", "counter", "transfer", "other"), F.col("k") % 4).alias("route"), F.when(F.col("k") % 10 == 0, "book:2").otherwise(F.col("candidate_id")).alias("candidate_id"),
        F.when(F.col("k") % 6 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat(F.lit("current:t:"), F.col("k") % 40))).alias("contexts"), F.array(F.when(F.col("k") % 8 == 0, "provider:none").otherwise(F.col("source_id"))).alias("providers"), F.when(F.col("k") % 9 == 0, "").otherwise("few").alias("gaps"),
    )


def _result_problems(s: SparkSession, d: str) -> DataFrame:
    approved = _table(s, d, "nation").select(F.concat(F.lit("current:t:"), "n_nationkey").alias("source_id"))
    return R.result_problems(_results(s, d), _found(s, d), approved, R.candidates(_feeds(s, d)), 5)


_FEED = """feed AS (SELECT 'a-feed' AS feed, p_partkey AS position, p_brand AS author, '' AS reason, CAST(NULL AS VARCHAR) AS category, true AS own, * FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'b-similar', p_partkey, p_type, 'like', NULL, false, * FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'c-search', p_partkey, p_brand, '', 'novel', true, * FROM part WHERE p_partkey % 5 = 0),
cnd AS (SELECT 'book:' || p_partkey AS candidate_id, CAST(p_partkey AS VARCHAR) AS book_id, p_name || ' ' || p_partkey AS title, CASE WHEN own AND p_partkey % 4 = 0 THEN '' ELSE author END AS author, category, p_size * 10 AS rating_count, p_partkey % 9 = 0 AS sold_out, feed, position,
  'provider:' || substring(sha256(feed || chr(0) || reason), 1, 16) AS source_id FROM feed WHERE p_partkey % 31 <> 0),
mrg AS (SELECT candidate_id, any_value(book_id) AS book_id, any_value(title) AS title, arg_min(author, feed) FILTER (author <> '') AS author, max(category) AS category, CAST(max(rating_count) AS BIGINT) AS rating_count, bool_or(sold_out) AS sold_out, string_agg(source_id, ',' ORDER BY feed) AS sources, NOT bool_or(sold_out) AS eligible FROM cnd GROUP BY candidate_id)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "shelf_entries": lambda s, d: L.shelf_entries(_payloads(s, d)),
    "shelf_counts": lambda s, d: L.shelf_counts(L.shelf_entries(_payloads(s, d))),
    "shelf_problems": lambda s, d: L.shelf_problems(L.shelf_entries(_payloads(s, d))),
    "direct_links": lambda s, d: L.direct_links(_shelf(s, d), _locals(s, d)),
    "candidate_links": lambda s, d: L.candidate_links(_shelf(s, d), _locals(s, d), L.direct_links(_shelf(s, d), _locals(s, d))),
    "greedy_links": _greedy,
    "library_overview": _overview,
    "library_summary": lambda s, d: L.summary(_overview(s, d)),
    "library_audit": lambda s, d: L.audit(_overview(s, d), _locals(s, d), _shelf(s, d)),
    "reading_snapshot": lambda s, d: R.reading_snapshot(_overview(s, d)),
    "session_records": _records,
    "session_items": _flat,
    "summary_problems": lambda s, d: S.summary_problems(_summaries(s, d).drop("author_explicit", "sources")),
    "dated_notes": _notes,
    "note_events": _marks,
    "insight_candidates": _insights,
    "weekly_tiers": lambda s, d: S.weekly_tiers(_records(s, d), _notes(s, d), _catalog(s, d), _insights(s, d), 480),
    "live_messages": lambda s, d: S.live_messages(_transcript(s, d).select("session_id", "event_id"), _transcript(s, d)),
    "stream_violations": lambda s, d: M.violations(_stream(s, d)),
    "stream_states": lambda s, d: M.states(_stream(s, d)),
    "stream_counts": lambda s, d: M.counts(M.states(_stream(s, d))),
    "recorded_candidates": lambda s, d: M.recorded(_requests(s, d), _stored(s, d)),
    "decided_items": lambda s, d: M.decided(_current(s, d), _decisions(s, d)),
    "remembered_items": lambda s, d: M.remembered(_requests(s, d), _stored(s, d)).drop("content_sha256"),
    "memory_mode": lambda s, d: M.memory_mode(_settings(s, d), _table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))),
    "mode_changes": lambda s, d: M.mode_changes(_settings(s, d)),
    "belief_sources": _beliefs,
    "task_states": lambda s, d: M.lifecycle(_tasks(s, d), ("context-review", "evidence-ready", "report-ready", "completed")),
    "context_sources": _sources,
    "context_bundle": lambda s, d: N.bundle_hash(_sources(s, d)),
    "context_selection": lambda s, d: N.selected(_sources(s, d), _choices(s, d)),
    "choice_problems": lambda s, d: N.choice_problems(_sources(s, d), _choices(s, d)),
    "context_review": _reviewed,
    "context_freeze": _packet,
    "context_staleness": _frozen_problems,
    "discovered_candidates": lambda s, d: R.candidates(_feeds(s, d)).drop("reason"),
    "merged_candidates": _found,
    "annotated_candidates": lambda s, d: R.annotated(_found(s, d), _snapshot(s, d)),
    "candidate_gate": lambda s, d: R.gate(_found(s, d), 3),
    "ranked_candidates": lambda s, d: R.ranked(_found(s, d)).select("candidate_id", "eligible", "rating_count", "title_key"),
    "query_problems": _query_problems,
    "recommendation_problems": _result_problems,
    "ratings": lambda s, d: _table(s, d, "part").select("p_partkey", X.rating_text(F.when(F.col("p_partkey") % 7 != 0, (F.col("p_size") * 20 + F.col("p_partkey") % 10).cast("string")).when(F.col("p_partkey") % 14 == 0, "bad"), F.when(F.col("p_size") > 5, F.col("p_size"))).alias("rating")),
}

_WEEK = "strftime({} + INTERVAL 480 MINUTE, '%G-W%V')"
_STREAM = """n1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN user_id % 3 = 0 THEN 1 ELSE event_id % 4 END AS k FROM events),
st AS (SELECT user_id AS item, event_id AS seq, n, CASE WHEN n = 1 THEN NULL WHEN n = 2 THEN 'candidate' WHEN user_id % 3 <> 0 AND event_id % 2 = 0 THEN 'confirmed' ELSE 'revised' END AS f, CASE WHEN n = 1 THEN 'candidate' ELSE ['confirmed', 'revised', 'rejected', 'retired'][k + 1] END AS t, k, event_type AS content, event_id % 11 = 0 AND user_id % 3 <> 0 AS bad FROM n1),
pv AS (SELECT *, lag(t) OVER (PARTITION BY item ORDER BY seq) AS was FROM st),
vio AS (SELECT item, seq, CASE WHEN bad THEN 'content-hash' WHEN n > 1 AND f IS DISTINCT FROM was THEN 'from-status'
  WHEN n > 1 AND NOT ((f = 'candidate' AND k < 3) OR (f IN ('confirmed', 'revised') AND k IN (1, 3))) THEN 'transition' END AS problem FROM pv),
good AS (SELECT item, arg_max(t, seq) AS status, arg_max(content, seq) AS content, 'e' || max(seq) AS event_id FROM st WHERE item NOT IN (SELECT item FROM vio WHERE problem IS NOT NULL) GROUP BY item)"""
_REQ = """req AS (SELECT CASE WHEN turn % 2 = 0 THEN 'goal' ELSE 'habit' END AS category, coalesce(text, '') AS content, CAST(conv_id AS VARCHAR) AS source, turn % 3 <> 0 AS said, conv_id FROM conversations WHERE role = 'user'),
idn AS (SELECT 'item-' || sha256(source || chr(0) || category || chr(0) || content) AS item, category, content, said, conv_id FROM req),
new_ AS (SELECT item, 'event-' || sha256('candidate' || chr(0) || item) AS event_id, category, content, bool_or(said) AS said FROM idn WHERE conv_id % 2 = 1 GROUP BY ALL)"""

ORACLE_SQL: dict[str, str] = {
    "shelf_entries": f"WITH {_ENTRIES} SELECT * FROM entries",
    "shelf_counts": f"WITH {_ENTRIES} SELECT shelf_id, count(*) FILTER (kind = 'book') AS books, count(*) FILTER (kind = 'album') AS albums, count(*) FILTER (kind = 'mp') AS mp, count(*) AS visible_entries FROM entries GROUP BY shelf_id",
    "shelf_problems": f"WITH {_ENTRIES} SELECT shelf_id, provider_identity, CASE WHEN provider_identity IS NULL THEN 'missing-identity' ELSE 'duplicate-identity' END AS problem FROM entries GROUP BY ALL HAVING provider_identity IS NULL OR count(*) > 1",
    "direct_links": f"WITH {_OVERVIEW} SELECT item_id, CASE WHEN n = 1 THEN stable_id END AS stable_id, CASE WHEN n > 1 THEN 'several-locals' END AS problem FROM shelf JOIN claims ON item_id = provider_id AND kind = 'book'",
    "greedy_links": f"WITH RECURSIVE {_GREEDY} SELECT item AS item_id, got.sid AS stable_id, CASE WHEN got.whole THEN 'exact-title-author' ELSE 'base-title-author' END AS basis FROM walk WHERE got IS NOT NULL",
    "candidate_links": f"WITH {_OVERVIEW} SELECT item_id, stable_id, CASE WHEN whole THEN 'exact-title-author' ELSE 'base-title-author' END AS basis FROM cand",
    "library_overview": f"WITH {_OVERVIEW} SELECT * FROM overview",
    "library_summary": f"WITH {_OVERVIEW} SELECT count(*) AS combined_entries, count(DISTINCT stable_id) AS local_books, count(DISTINCT stable_id) FILTER (provider_identity IS NOT NULL) AS linked_books, count(DISTINCT stable_id) FILTER (local_text_status = 'text-ready') AS full_text_books, count(DISTINCT stable_id) FILTER (analysis_status = 'discussion-ready') AS analysed_books, count(*) FILTER (discussion_available) AS discussable FROM overview",
    "library_audit": """SELECT unnest(['shelf_identity_present', 'shelf_identity_unique', 'overview_identity_unique', 'local_links', 'one_entry_a_book', 'text_status_known']) AS "check", 0::BIGINT AS violations, true AS ok""",
    "reading_snapshot": f"WITH {_OVERVIEW} SELECT provider_identity, kind, stable_id, link_status, text_status, discussion_available FROM overview",
    "session_records": f"WITH {_SESS} SELECT * FROM rec",
    "session_items": """WITH c AS (SELECT DISTINCT conv_id FROM conversations), i AS (SELECT conv_id, unnest([0, 1, 2]) AS p FROM c)
SELECT conv_id AS session_id, CAST(p AS INTEGER) AS position, CASE p WHEN 0 THEN 'a' || conv_id WHEN 1 THEN 'c' || conv_id ELSE '{"locator":"l"}' END AS text, CASE p WHEN 1 THEN 's' WHEN 2 THEN 'l' END AS locator, n_name || '|x' || conv_id % 3 AS books, 'loc' || conv_id || '|src' || conv_id AS evidence FROM i JOIN nation ON n_nationkey = conv_id % 25""",
    "summary_problems": "WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id AS session_id, 'missing:unresolved' AS problem FROM c WHERE conv_id % 4 <> 1 UNION ALL SELECT conv_id, 'too-many-profile-candidates' FROM c WHERE conv_id % 6 > 3",
    "dated_notes": f"WITH {_NOTES} SELECT * FROM notes",
    "note_events": """WITH m AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS b, event_id % 7 AS c, event_id || '-' || (event_id + 9) AS r FROM events WHERE event_type = 'view')
SELECT 'highlight:' || CASE WHEN b <> '' THEN b ELSE 'sha256:' || sha256(CAST(to_json({'bookmarkId': b, 'chapterUid': c, 'createTime': event_id, 'markText': props, 'range': r}) AS VARCHAR)) END AS event_id, 'highlight' AS event, user_id AS book_id, c AS chapter_uid, CASE WHEN c < 5 THEN CAST(c + 1 AS INTEGER) END AS chapter_idx, CASE WHEN c < 5 THEN 'Chapter ' || (c + 1) END AS chapter_title, props AS mark_text, r AS "range", event_id AS create_time FROM m""",
    "insight_candidates": f"WITH {_INS} SELECT candidate_id, 'belief-' || substring(sha256(candidate_id), 1, 16) AS belief_id, session_id, content FROM cands",
    "weekly_tiers": f"""WITH {_SESS}, {_NOTES}, {_INS}, e AS (SELECT {_WEEK.format("started_at")} AS week, CASE status WHEN 'completed' THEN 3 ELSE 4 END AS t FROM rec UNION ALL SELECT {_WEEK.format("occurred_at")}, 2 FROM notes UNION ALL SELECT {_WEEK.format("ts")}, 1 FROM events WHERE event_type = 'signup' AND event_id % 2 = 0 UNION ALL SELECT {_WEEK.format("started_at")}, 5 FROM cands JOIN rec USING (session_id)),
g AS (SELECT week, count(*) FILTER (t = 1) AS book_imports, count(*) FILTER (t = 2) AS notes, count(*) FILTER (t = 3) AS completed_discussions, count(*) FILTER (t = 4) AS skipped_discussions, count(*) FILTER (t = 5) AS candidate_beliefs FROM e GROUP BY week)
SELECT *, concat_ws(',', CASE WHEN notes = 0 THEN 'no-notes' END, CASE WHEN completed_discussions + skipped_discussions = 0 THEN 'no-sessions' END, CASE WHEN candidate_beliefs = 0 THEN 'no-candidates' END) AS evidence_gaps FROM g""",
    "live_messages": "SELECT conv_id AS session_id, turn AS event_id FROM conversations WHERE role = 'user' AND NOT (conv_id % 7 = 0 AND turn = 0) AND turn % 4 <> 3",
    "stream_violations": f"WITH {_STREAM} SELECT * FROM vio WHERE problem IS NOT NULL",
    "stream_states": f"WITH {_STREAM} SELECT * FROM good",
    "stream_counts": f"WITH {_STREAM} SELECT count(*) FILTER (status IN ('confirmed', 'revised')) AS active, count(*) FILTER (status = 'candidate') AS pending, count(*) AS items FROM good",
    "recorded_candidates": f"WITH {_REQ} SELECT item, event_id, 'candidate' AS kind, 'candidate' AS to_status, category, content, sha256(content) AS content_sha256 FROM new_",
    "decided_items": """WITH c AS (SELECT c_custkey AS item, ['candidate', 'confirmed', 'revised', 'rejected', 'retired'][c_custkey % 5 + 1] AS s, ['confirm', 'revise', 'reject', 'retire'][c_nationkey % 4 + 1] AS decision, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'ok' END AS said, CASE WHEN c_nationkey % 4 = 1 THEN CASE WHEN c_custkey % 3 <> 0 THEN c_name END ELSE c_mktsegment END AS text, c_mktsegment AS content FROM customer),
t AS (SELECT *, CASE WHEN s = 'candidate' AND decision = 'confirm' THEN 'confirmed' WHEN s IN ('candidate', 'confirmed', 'revised') AND decision = 'revise' THEN 'revised' WHEN s = 'candidate' AND decision = 'reject' THEN 'rejected' WHEN s IN ('confirmed', 'revised') AND decision = 'retire' THEN 'retired' END AS target FROM c),
o AS (SELECT *, CASE WHEN s = 'confirmed' AND decision = 'confirm' AND said = 'ok' THEN 'duplicate' WHEN target IS NULL OR text IS NULL OR said = '' THEN 'rejected' ELSE 'appended' END AS outcome FROM t)
SELECT item, decision, outcome, CASE WHEN outcome = 'appended' THEN 'event-' || sha256('decision' || chr(0) || item || chr(0) || 'e' || item || chr(0) || decision || chr(0) || said || chr(0) || text) END AS event_id, CASE WHEN outcome = 'appended' THEN s END AS from_status, CASE WHEN outcome = 'appended' THEN target END AS to_status, CASE WHEN outcome = 'appended' THEN sha256(text) END AS content_sha256 FROM o""",
    "remembered_items": f"WITH {_REQ} SELECT item, event_id, 'candidate' AS kind, 'candidate' AS to_status, category, content FROM new_ WHERE said UNION ALL SELECT item, 'event-' || sha256('decision' || chr(0) || item || chr(0) || event_id || chr(0) || 'confirm' || chr(0) || 'remember this' || chr(0) || content), 'decision', 'confirmed', category, content FROM new_ WHERE said",
    "memory_mode": "SELECT c_custkey AS user_id, CASE arg_max(o_orderstatus, o_orderkey) WHEN 'F' THEN 'off' WHEN 'O' THEN 'proactive-review' ELSE 'explicit-only' END AS mode, count(o_orderkey) > 0 AS configured FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "mode_changes": "WITH m AS (SELECT o_custkey AS user_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'off' WHEN 'O' THEN 'proactive-review' ELSE 'explicit-only' END AS mode FROM orders) SELECT * FROM m QUALIFY lag(mode) OVER (PARTITION BY user_id ORDER BY seq) IS DISTINCT FROM mode",
    "belief_sources": f"WITH {_SRC} SELECT source_id, content, exclusion_basis, selected_by_default, requires_explicit_selection FROM src WHERE source_type = 'belief'",
    "task_states": "WITH t AS (SELECT o_custkey AS task, bool_or(o_orderkey % 5 = 0) AS a, bool_or(o_orderkey % 5 = 1) AS b, bool_or(o_orderkey % 5 = 2) AS c, bool_or(o_orderkey % 5 = 3) AS d, max(o_orderkey) % 5 = 4 AS failed FROM orders GROUP BY o_custkey) SELECT task, CASE WHEN a AND b AND c AND d THEN 'completed' WHEN a AND b AND c THEN 'report-ready' WHEN a AND b THEN 'evidence-ready' WHEN a THEN 'context-review' ELSE 'new' END AS state, failed FROM t",
    "context_sources": f"WITH {_SRC} SELECT *, count(*) OVER (PARTITION BY source_id) > 1 AS duplicate FROM src",
    "context_bundle": f"""WITH {_SRC}, h AS (SELECT sha256(source_id || chr(0) || source_type || chr(0) || coalesce(content, chr(1)) || chr(0) || coalesce(exclusion_basis, chr(1)) || chr(0) || selected_by_default || chr(0) || requires_explicit_selection) AS h FROM src),
b AS (SELECT substring(h, 1, 2) AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS sources, sha256(string_agg(h, chr(10) ORDER BY b)) AS bundle_sha256 FROM b""",
    "context_selection": f"WITH {_SEL} SELECT source_id, basis IS NOT NULL AND basis <> 'excluded' AS selected, basis FROM sel",
    "choice_problems": f"WITH {_SRC}, {_CHO} SELECT cho.source_id, CASE WHEN src.source_id IS NULL THEN 'unknown' ELSE 'included-and-excluded' END AS problem FROM cho LEFT JOIN src ON cho.source_id = src.source_id AND exclusion_basis IS NULL WHERE src.source_id IS NULL OR (inc AND exc)",
    "context_review": f"WITH {_SRC}, {_CHO}, r AS (SELECT source_id, CASE WHEN exc THEN 'excluded' WHEN inc OR source_type = 'current-request' OR (source_type = 'belief' AND source_id LIKE '%5') THEN 'explicit-user-context-confirmation' END AS basis FROM src LEFT JOIN cho USING (source_id) WHERE exclusion_basis IS NULL) SELECT source_id, basis IS NOT NULL AND basis <> 'excluded' AS selected, basis FROM r",
    "context_freeze": f"WITH {_SEL} SELECT source_id, basis, sha256(source_id || chr(0) || coalesce(content, '')) AS content_sha256 FROM sel WHERE basis <> 'excluded'",
    "context_staleness": f"WITH {_SEL}, x AS (SELECT source_id, CASE WHEN source_id LIKE '%3' THEN 'not-available' WHEN source_id LIKE '%7' THEN 'changed' WHEN requires_explicit_selection AND (source_id LIKE '%0' OR basis <> 'explicit-user-context-confirmation') THEN 'not-chosen' END AS problem FROM sel WHERE basis <> 'excluded') SELECT * FROM x WHERE problem IS NOT NULL",
    "discovered_candidates": f"WITH {_FEED} SELECT * REPLACE (CAST(rating_count AS BIGINT) AS rating_count) FROM cnd",
    "merged_candidates": f"WITH {_FEED} SELECT * FROM mrg",
    "annotated_candidates": f"WITH {_FEED} SELECT m.candidate_id, CASE WHEN p.p_partkey IS NULL THEN NULL WHEN p.p_partkey % 2 = 0 THEN 'provider-id' WHEN {_KEY.format('p.p_type')} = {_KEY.format('m.author')} THEN 'title-author-only' END AS basis, CASE WHEN p.p_partkey % 2 = 0 OR {_KEY.format('p.p_type')} = {_KEY.format('m.author')} THEN 'L' || p.p_partkey END AS stable_id FROM mrg m LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = m.book_id AND p.p_partkey % 7 = 0",
    "candidate_gate": f"WITH {_FEED} SELECT count(*) FILTER (eligible) AS eligible, 9::BIGINT AS needed, count(*) FILTER (eligible) >= 9 AS enough FROM mrg",
    "ranked_candidates": f"WITH {_FEED} SELECT candidate_id, eligible, rating_count, {_KEY.format('title')} AS title_key FROM mrg",
    "query_problems": rf"""WITH {_SRC}, ql AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN string_split(coalesce(text, ''), chr(10)) WHEN 1 THEN ['books on skill'] WHEN 2 THEN [''] WHEN 3 THEN [repeat('long ', 20)] ELSE ['novels of the sea'] END AS ls FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id || '-' || turn || '-' || (generate_subscripts(ls, 1) - 1) AS query_id, unnest(ls) AS query FROM ql),
k AS (SELECT DISTINCT regexp_replace(replace(lower(content), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g') AS key FROM stm WHERE length(content) >= 20),
p AS (SELECT query_id, CASE WHEN trim(query) = '' THEN 'empty' WHEN length(query) > 80 THEN 'too-long' WHEN regexp_matches(query, '(?i)(api[ _-]?key|access[ _-]?token|authorization|credential|secret|password|skill|密钥|密码|令牌)') THEN 'private' WHEN regexp_replace(replace(lower(query), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g') IN (SELECT key FROM k) THEN 'copies-a-statement' END AS problem FROM q) SELECT * FROM p WHERE problem IS NOT NULL""",
    "recommendation_problems": f"""WITH {_FEED}, r AS (SELECT min(position) AS item, candidate_id AS own, min(source_id) AS sid FROM cnd GROUP BY candidate_id), s AS (SELECT item, sid, ['deepen', 'counter', 'transfer', 'other'][item % 4 + 1] AS route, CASE WHEN item % 10 = 0 THEN 'book:2' ELSE own END AS candidate_id, CASE WHEN item % 8 = 0 THEN 'provider:none' ELSE sid END AS p FROM r)
SELECT CAST(item AS VARCHAR) AS key, 'candidate-not-eligible' AS problem FROM s WHERE candidate_id NOT IN (SELECT candidate_id FROM mrg WHERE eligible) UNION ALL SELECT CAST(item AS VARCHAR), 'candidate-used-twice' FROM s WHERE candidate_id IN (SELECT candidate_id FROM s GROUP BY candidate_id HAVING count(*) > 1)
UNION ALL SELECT CAST(item AS VARCHAR), 'unknown-route' FROM s WHERE route = 'other' UNION ALL SELECT CAST(item AS VARCHAR), 'no-context' FROM s WHERE item % 6 = 0 UNION ALL SELECT CAST(item AS VARCHAR), 'no-gaps' FROM s WHERE item % 9 = 0 UNION ALL SELECT CAST(item AS VARCHAR), 'context-not-approved' FROM s WHERE item % 6 <> 0 AND item % 40 >= 25
UNION ALL SELECT CAST(item AS VARCHAR), 'provider-not-of-candidate' FROM s WHERE (candidate_id, p) NOT IN (SELECT (candidate_id, source_id) FROM cnd) UNION ALL SELECT route, 'wrong-number-of-items' FROM (SELECT unnest(['deepen', 'counter', 'transfer']) AS route) x WHERE (SELECT count(*) FROM s WHERE s.route = x.route) <> 5""",
    "ratings": """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size * 20 + p_partkey % 10 AS DOUBLE) END AS v, p_size FROM part), n AS (SELECT *, CASE WHEN v > 100 THEN v / 10 ELSE v END AS w FROM r)
SELECT p_partkey, CASE WHEN v IS NULL THEN '暂无评分' ELSE regexp_replace(regexp_replace(printf('%.1f', w), '0+$', ''), '\\.$', '') || '/100' || CASE WHEN p_size > 5 THEN '（' || p_size || ' 人评分）' ELSE '' END END AS rating FROM n""",
}
