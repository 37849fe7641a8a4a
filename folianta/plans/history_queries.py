"""Queries over histories: each user's events in their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import histories
from .registry import query, table

_REVISE = ("record", "adopt", "undo", "record", "redo", "undo", "record", "saved", "adopt", "undo", "redo", "unsaved", "record", "undo", "undo_failed", "redo_failed", "seed", "record", "undo", "redo", "clear", "record", "record")
_VIEW = ("record", "previous", "record", "next", "record", "previous", "record", "next", "previous", "record", "clear", "record", "previous")
ENTRIES, BYTES, VIEWS = 3, 2000, 4


def _of(names, n):
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def _listed(names, n):
    return f"[{', '.join(repr(x) for x in names)}][({n} % {len(names)} + 1)::INT]"


_STATE = "STRUCT(id VARCHAR, bytes BIGINT, digest VARCHAR)"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS doc_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, {_listed(_REVISE, "(event_id * 7 + user_id)")} AS action,
  CASE WHEN event_id % 5 = 0 THEN 'own-' || event_id % 9 END AS rid, CASE WHEN event_id % 7 = 0 THEN 'revision-' || event_id % 4 END AS base, event_id % 11 * 90 AS bytes, 'd' || event_id % 3 AS digest FROM events),
w AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 0::BIGINT AS seq, []::{_STATE}[] AS past, NULL::{_STATE} AS cur, []::{_STATE}[] AS future, NULL::VARCHAR AS saved, 0::BIGINT AS n, false AS moved, NULL::VARCHAR AS error FROM e
UNION ALL
SELECT doc_id, k, seq,
  CASE WHEN act IN ('seed', 'clear') THEN [] WHEN act = 'add' THEN list_append(past, cur)[list_min(list_filter(range(1, len(past) + 3), lambda i: i = len(past) + 2 OR (len(past) + 2 - i <= {ENTRIES}
      AND coalesce(list_sum(list_transform(list_append(past, cur)[i:], lambda r: r.bytes)), 0) + cur.bytes + coalesce(list_sum(list_transform(future, lambda r: r.bytes)), 0) <= {BYTES}))):]
    WHEN act = 'undo' THEN past[:-2] WHEN act = 'redo' THEN list_append(past, cur) ELSE past END,
  CASE WHEN act IN ('seed', 'add') THEN {{'id': coalesce(rid, 'revision-' || (n + 1)), 'bytes': bytes, 'digest': digest}} WHEN act = 'clear' THEN NULL WHEN act = 'undo' THEN past[-1] WHEN act = 'redo' THEN future[1] ELSE cur END,
  CASE WHEN act IN ('seed', 'clear', 'add') THEN [] WHEN act = 'undo' THEN list_prepend(cur, future) WHEN act = 'redo' THEN future[2:] ELSE future END,
  CASE WHEN act = 'seed' THEN coalesce(rid, 'revision-' || (n + 1)) WHEN act = 'saved' THEN cur.id WHEN act IN ('unsaved', 'clear') THEN NULL ELSE saved END,
  n + (act IN ('seed', 'add'))::INT, act IN ('seed', 'add', 'undo', 'redo') OR (act = 'clear' AND cur IS NOT NULL), CASE WHEN act = 'stale' THEN 'stale base' END
FROM (SELECT w.doc_id, e.k, e.seq, w.past, w.cur, w.future, w.saved, w.n, e.rid, e.bytes, e.digest,
  CASE WHEN e.action = 'seed' OR (e.action IN ('record', 'adopt') AND w.cur IS NULL) THEN 'seed'
    WHEN e.action IN ('record', 'adopt') THEN CASE WHEN e.base <> w.cur.id THEN 'stale' WHEN e.bytes = w.cur.bytes AND e.digest = w.cur.digest THEN 'none' ELSE 'add' END
    WHEN e.action IN ('undo', 'redo_failed') THEN CASE WHEN len(w.past) > 0 THEN 'undo' ELSE 'none' END
    WHEN e.action IN ('redo', 'undo_failed') THEN CASE WHEN len(w.future) > 0 THEN 'redo' ELSE 'none' END ELSE e.action END AS act
  FROM w JOIN e ON e.doc_id = w.doc_id AND e.k = w.k + 1))
SELECT doc_id, seq, cur.id AS revision, moved, len(past) > 0 AS can_undo, len(future) > 0 AS can_redo, coalesce(cur.id = saved, false) AS at_saved, len(past) + len(future) + (cur IS NOT NULL)::INT AS kept, error FROM w WHERE k > 0""")
def revision_states(spark, sf_dir):
    """What can be undone and redone after each of a document's edits."""
    n, u = F.col("event_id"), F.col("user_id")
    events = table(spark, sf_dir, "events").select(
        u.alias("doc_id"), n.alias("seq"), _of(_REVISE, n * 7 + u).alias("action"), F.when(n % 5 == 0, F.concat(F.lit("own-"), n % 9)).alias("revision_id"),
        F.when(n % 7 == 0, F.concat(F.lit("revision-"), n % 4)).alias("base_id"), (n % 11 * 90).alias("bytes"), F.concat(F.lit("d"), n % 3).alias("digest"),
    )
    return histories.replay(events, histories.revisions(ENTRIES, BYTES))


_FIRST = "list_max(list_filter(range(1, len({s}) + 1), lambda i: {s}[i] <= pages AND {s}[i] <> page))"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, {_listed(_VIEW, "(event_id * 5 + user_id)")} AS action, event_id % 9 AS page, 5 + event_id % 4 AS pages FROM events),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS seq, []::BIGINT[] AS back, []::BIGINT[] AS ahead, NULL::BIGINT AS "to" FROM e
UNION ALL
SELECT user_id, k, seq,
  CASE WHEN action = 'clear' THEN [] WHEN action = 'record' AND page >= 1 THEN CASE WHEN back[-1] = page THEN back ELSE list_append(back, page)[-{VIEWS}:] END WHEN action = 'previous' THEN coalesce(back[:b - 1], []) WHEN action = 'next' AND a IS NOT NULL THEN list_append(back, page) ELSE back END,
  CASE WHEN action = 'clear' OR (action = 'record' AND page >= 1) THEN [] WHEN action = 'next' THEN coalesce(ahead[:a - 1], []) WHEN action = 'previous' AND b IS NOT NULL THEN list_append(ahead, page) ELSE ahead END,
  CASE WHEN action = 'previous' THEN back[b] WHEN action = 'next' THEN ahead[a] END
FROM (SELECT w.user_id, e.k, e.seq, e.action, e.page, e.pages, w.back, w.ahead, {_FIRST.format(s="w.back")} AS b, {_FIRST.format(s="w.ahead")} AS a FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1))
SELECT user_id, seq, "to", len(back) AS n_back, len(ahead) AS n_ahead FROM w WHERE k > 0""")
def view_history(spark, sf_dir):
    """Where previous and next lead, after each of a reader's jumps."""
    n = F.col("event_id")
    events = table(spark, sf_dir, "events").select("user_id", n.alias("seq"), _of(_VIEW, n * 5 + F.col("user_id")).alias("action"), (n % 9).alias("page"), (5 + n % 4).alias("pages"))
    return histories.replay(events, histories.views(VIEWS), key="user_id")
