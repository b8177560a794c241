"""DuckDB SQL for the derived fixture views, used only by oracle queries.

Each constant is a CTE body (``name AS (...)``); :func:`with_views` puts the
needed ones in front of a query.  Only the driver tables are assumed to exist.
"""

from __future__ import annotations

from foldwise.constants import TARGETS


def _score(j: int) -> str:
    return f"CAST(1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * ((n_chars + {j} * doc_id) % 9)"


ESSAYS = "essays AS (SELECT CAST(doc_id AS VARCHAR) AS text_id, doc_id, text AS full_text, " + ", ".join(
    f"{_score(j)} AS {t}" for j, t in enumerate(TARGETS, start=1)) + " FROM documents)"

TARGETS6 = "targets6 AS (" + " UNION ALL ".join(
    f"SELECT {j} AS j, '{t}' AS target" for j, t in enumerate(TARGETS, start=1)) + ")"

FOLDS5 = "folds5 AS (SELECT CAST(range AS INTEGER) AS fold FROM range(5))"

FOLD_PREDS = ("fold_preds AS (SELECT CAST(d.doc_id AS VARCHAR) AS text_id, f.fold, t.target, "
              "CAST((d.n_chars + d.doc_id * f.fold + t.j) % 3 AS INTEGER) AS label, "
              "CAST((d.doc_id * (f.fold + 1) + t.j) % 100 AS DOUBLE) / 100 AS prob "
              "FROM documents d CROSS JOIN folds5 f CROSS JOIN targets6 t)")

FIRST_STAGE = ("first_stage AS (SELECT e.text_id, CAST(s.range AS INTEGER) AS src, " + ", ".join(
    f"e.{t} + CAST(0.1 AS DOUBLE) * ((e.doc_id + s.range + {j}) % 5 - 2) AS {t}"
    for j, t in enumerate(TARGETS, start=1)) + " FROM essays e CROSS JOIN range(4) s)")

LOSS_LOG = ("loss_log AS (SELECT event_type AS run, CAST(row_number() OVER "
            "(PARTITION BY event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS step, "
            "value AS loss FROM events)")

HIDDEN = ("hidden AS (SELECT CAST(floor(vec_id / 40) AS BIGINT) AS doc, "
          "CAST(floor(vec_id / 10) % 4 AS INTEGER) AS layer, CAST(vec_id % 10 AS INTEGER) AS pos, "
          "CAST(CASE WHEN vec_id % 10 < label % 8 + 3 THEN 1 ELSE 0 END AS INTEGER) AS mask, "
          "CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)")


WORD_LABELS = ("word_labels AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, word, "
               "CAST(length(word) % 8 AS INTEGER) AS label FROM ("
               "SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos "
               "FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))")

LABELLED_FOLDS = ("lf AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, "
                  "CAST((row_number() OVER (ORDER BY l.quality, l.toxic, "
                  "md5(concat_ws(':', '42', d.doc_id)), d.doc_id) - 1) % 5 AS INTEGER) AS fold "
                  "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"

TNAMES0 = "tnames AS (" + " UNION ALL ".join(
    f"SELECT {j} AS j, '{t}' AS target" for j, t in enumerate(TARGETS)) + ")"

# one row per (id, target j, level c) with the logit v and the true level of (id, j)
LOGIT_CELLS = (TNAMES0 + ",\nlg AS (SELECT vec_id AS id, label, CAST(r.i AS INTEGER) AS i, "
               "sum(CAST(embedding[x.x + 1] AS DOUBLE) * ((7 * x.x + 3 * r.i) % 11 - 5) / 10) AS v "
               "FROM embeddings CROSS JOIN range(54) r(i) CROSS JOIN range(64) x(x) GROUP BY vec_id, label, r.i),\n"
               "cells AS (SELECT lg.id, CAST(lg.i % 6 AS INTEGER) AS j, t.target, "
               "CAST(floor(lg.i / 6) AS INTEGER) AS c, lg.v, "
               "CAST((lg.label + lg.i % 6) % 9 AS INTEGER) AS level "
               "FROM lg JOIN tnames t ON t.j = lg.i % 6),\n"
               "mxs AS (SELECT *, max(v) OVER (PARTITION BY id, j) AS mx FROM cells),\n"
               "sm AS (SELECT *, sum(exp(v - mx)) OVER (PARTITION BY id, j) AS se FROM mxs),\n"
               "probs AS (SELECT id, j, target, c, v, level, exp(v - mx) / se AS p, mx + ln(se) AS lse FROM sm)")

# hidden states by dimension: one row per (doc, layer, pos, dim)
HIDDEN_DIMS = HIDDEN + (",\nhd AS (SELECT doc, layer, pos, mask, CAST(r.i AS INTEGER) AS dim, vec[r.i + 1] AS v, "
                        "vec[1] AS score FROM hidden CROSS JOIN range(64) r(i))")
