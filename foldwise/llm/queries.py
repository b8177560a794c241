"""Registered queries of the ten operators, with DuckDB oracle SQL where SQL can say it.

Each query applies its operator with production parameters to its whole table
and derives the digest columns from the operator's output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bpe, chat, dedup, fim, html_text, langid, mixing, ngram_join, packing, quality, repair, topk, toxicity
from foldwise.llm.common import crc_mod, table, vocabulary_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return deco


@register("""
WITH x AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM x WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT vec_id, i, CAST(floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM x WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score
  FROM v q JOIN v d ON q.i = d.i AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@register()
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def _quality_sql() -> str:
    space = r"[\x20\x09-\x0D]"

    def ratio(part: str, whole: str, bins: int, most: int | None = None) -> str:
        r = f"CASE WHEN {whole} > 0 THEN ({part}) * {bins} // ({whole}) ELSE -1 END"
        return r if most is None else f"least({r}, {most})"

    bins = {
        "length": "length(bin(n_words))",
        "symbols": ratio(r"len(regexp_extract_all(t, '[%*#$&|!<>{}=@~^+\\/]'))", "n", 50, 20),
        "capitals": ratio("len(regexp_extract_all(t, '[A-Z]'))", "n", 10),
        "digits": ratio("len(regexp_extract_all(t, '[0-9]'))", "n", 50, 20),
        "distinct": ratio("len(list_distinct(words))", "n_words", 10),
        "lines": ratio("len(list_distinct(rows))", "len(rows)", 5),
        "words": ratio("n", "n_words", 1, 20)}
    names = list(bins)
    strength = f"""coalesce(CASE WHEN sum(n * (k / n - prior) * (k / n - prior)) / sum(n) - sum(prior * (1 - prior)) / sum(n) > 0
      THEN least(greatest(sum(n * prior * (1 - prior)) / sum(n)
             / (sum(n * (k / n - prior) * (k / n - prior)) / sum(n) - sum(prior * (1 - prior)) / sum(n)) - 1, {quality.STRENGTH[0]}), {quality.STRENGTH[1]})
      ELSE {quality.STRENGTH[1]} END, {quality.STRENGTH[1]})"""
    return f"""
WITH t0 AS (
  SELECT doc_id, source AS host, lang AS path, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda w: w <> '') AS rows FROM documents),
t1 AS (SELECT *, len(words) AS n_words FROM t0),
f AS (SELECT doc_id, host, path, {', '.join(f'{e} AS "{f}_"' for f, e in bins.items())} FROM t1),
y AS (SELECT f.*, CAST(quality > 0 AS INT) AS y FROM f JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
long AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {chr(34)}{f}_{chr(34)} AS bin, y FROM y" for f in names)}),
counts AS (SELECT feature, bin, sum(y) AS good, sum(1 - y) AS bad FROM long GROUP BY ALL),
llr AS (
  SELECT feature, bin, ln((good + 1) / CAST(sum(good) OVER (PARTITION BY feature) + count(*) OVER (PARTITION BY feature) AS DOUBLE))
                     - ln((bad + 1) / CAST(sum(bad) OVER (PARTITION BY feature) + count(*) OVER (PARTITION BY feature) AS DOUBLE)) AS llr FROM counts),
base AS (SELECT (sum(y) + 1) / CAST(count(*) + 2 AS DOUBLE) AS prior FROM y),
paths AS (SELECT host, path, sum(y) AS k, CAST(count(*) AS DOUBLE) AS n FROM y GROUP BY ALL),
hosts AS (SELECT host, sum(k) AS k, sum(n) AS n, any_value(prior) AS prior FROM paths, base GROUP BY host),
hs AS (SELECT {strength} AS s FROM hosts),
hr AS (SELECT host, (k + s * prior) / (n + s) AS prior FROM hosts, hs),
under AS (SELECT p.*, prior FROM paths p JOIN hr ON hr.host IS NOT DISTINCT FROM p.host),
ps AS (SELECT {strength} AS s FROM under),
pr AS (SELECT host, path, (k + s * prior) / (n + s) AS path_rate FROM under, ps),
e AS (
  SELECT f.doc_id, f.host, f.path, {quality.TRUST} * ({' + '.join(f'coalesce(l_{f}.llr, 0)' for f in names)}) AS evidence,
         coalesce(hr.prior, base.prior) AS host_rate, coalesce(path_rate, hr.prior, base.prior) AS path_rate
  FROM f, base {' '.join(f"LEFT JOIN llr l_{f} ON l_{f}.feature = '{f}' AND l_{f}.bin = f.{chr(34)}{f}_{chr(34)}" for f in names)}
  LEFT JOIN hr ON hr.host IS NOT DISTINCT FROM f.host
  LEFT JOIN pr ON pr.host IS NOT DISTINCT FROM f.host AND pr.path IS NOT DISTINCT FROM f.path),
s AS (SELECT *, 1 / (1 + exp(-(evidence + ln(path_rate / (1 - path_rate))))) AS score FROM e)
SELECT doc_id, host, path, round(evidence, 6) AS evidence, round(host_rate, 6) AS host_rate, round(path_rate, 6) AS path_rate,
       round(score, 6) AS score, score >= {quality.KEEP} AS keep FROM s"""


def _mixing_sql() -> str:
    """The raking to the token budget as a recursion over rounds, which ends as the operator's does."""
    margins = ("source", "lang", "topic")
    marks = "(n_chars_ - length(replace(t, '{0}', ''))) * 50 >= n_chars_ + 100"
    out = rf"""
WITH RECURSIVE mixed0 AS (SELECT *, coalesce(text, '') AS t, length(coalesce(text, '')) AS n_chars_ FROM documents),
mixed AS (
  SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_tokens,
         CASE WHEN {marks.format('|')} THEN 'table' WHEN {marks.format('!!')} THEN 'shouting' WHEN n_chars_ < 200 THEN 'note'
              WHEN n_chars_ >= 5000 THEN 'long prose' ELSE 'prose' END AS topic
  FROM mixed0),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM mixed GROUP BY ALL),
size AS (SELECT {mixing.BUDGET} * sum(n) AS wanted FROM cells),"""
    for m in margins:                     # values that give all they have come first by have / share
        out += f"""
have_{m} AS (SELECT {m}, sum(n) AS have, CASE WHEN sum(n) > 0 THEN pow(sum(n), {mixing.TEMPER}) ELSE 0 END AS p FROM cells GROUP BY {m}),
share_{m} AS (SELECT *, p / sum(p) OVER () AS share FROM have_{m}),
rank_{m} AS (
  SELECT *, have / share AS ratio, coalesce(sum(have) OVER w, 0) AS full_, sum(share) OVER () - coalesce(sum(share) OVER w, 0) AS rest
  FROM share_{m} WHERE share > 0 WINDOW w AS (ORDER BY have / share, have, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scale_{m} AS (SELECT coalesce(max((wanted - full_) / rest) FILTER ((wanted - full_) / rest < ratio), max(ratio)) AS scale FROM rank_{m}, size),
goal_{m} AS (SELECT {m}, least(share * scale, have) AS goal FROM share_{m}, scale_{m}),"""
    same = " ".join(f"LEFT JOIN goal_{m} g_{m} ON g_{m}.{m} IS NOT DISTINCT FROM c.{m}" for m in margins)

    def raked(inner: str) -> str:
        for m in margins:
            total = f"sum(w) OVER (PARTITION BY {m})"
            inner = f"(SELECT * REPLACE (CASE WHEN {total} > 0 THEN least(n, w * goal_{m} / {total}) ELSE 0 END AS w) FROM {inner})"
        return inner

    errors = ", ".join(f"sum(abs(s_{m} - goal_{m}) / k_{m}) OVER ()" for m in margins)
    sums = ", ".join(f"sum(w) OVER (PARTITION BY {m}) AS s_{m}, count(*) OVER (PARTITION BY {m}) AS k_{m}" for m in margins)
    again = "now"
    for _ in range(mixing.CUT):
        again = raked(again)
    return out + f"""
start AS (SELECT c.*, n * {mixing.BUDGET} AS w, wanted, {', '.join(f'g_{m}.goal AS goal_{m}' for m in margins)}, 0 AS round, CAST('inf' AS DOUBLE) AS error
  FROM cells c {same}, size),
now AS (
  SELECT * FROM start
  UNION ALL
  SELECT source, lang, topic, n, w, wanted, {', '.join(f'goal_{m}' for m in margins)}, round + {mixing.CUT}, greatest({errors}) / wanted
  FROM (SELECT *, {sums} FROM {again} r) WHERE wanted > 0 AND error > {mixing.TOLERANCE} AND round < {mixing.MOST_ROUNDS}),
chances AS (
  SELECT source, lang, topic, CASE WHEN n > 0 THEN w / n ELSE 0 END AS probability
  FROM now WHERE round = (SELECT max(round) FROM now))
SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.n_tokens AS BIGINT) AS n_tokens, round(probability / {mixing.BUDGET}, 6) AS weight,
       round(probability, 6) AS probability,
       CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < probability AS sampled
FROM mixed d JOIN chances c ON c.source IS NOT DISTINCT FROM d.source AND c.lang IS NOT DISTINCT FROM d.lang AND c.topic = d.topic"""


@register(_quality_sql())
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its text, source (host) and language there
    (path), learned from all labels."""
    docs = table(spark, sf_dir, "documents")
    found = quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return found.withColumns({c: F.round(c, 6) for c in ("evidence", "host_rate", "path_rate", "score")})


@register(_mixing_sql())
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated weight and sampling decision of every document, at the pipeline's token budget."""
    found = mixing.decided(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


#: Components of documents whose shingle sets are similar, over a table ``docs``.
NEAR_SQL = r"""
w0 AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[\x20\x09-\x0D]+') AS words FROM docs)),
w AS (
  SELECT doc_id, i, word, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS w2, lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w3,
         count(*) OVER (PARTITION BY doc_id) AS k
  FROM w0 WHERE word <> ''),
shingles AS (
  SELECT DISTINCT doc_id, word || ' ' || w2 || ' ' || w3 AS g FROM w WHERE w3 IS NOT NULL
  UNION ALL SELECT doc_id, string_agg(word, ' ' ORDER BY i) FROM w WHERE k < 3 GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b USING (g)
  WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
pairs AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(doc_id, other) AS (SELECT x, y FROM links UNION SELECT doc_id, y FROM reach JOIN links ON other = x)"""


@register(f"""
WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {NEAR_SQL}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id, coalesce(l, 0) AS n_links
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
LEFT JOIN (SELECT x, count(*) AS l FROM links GROUP BY x) k ON k.x = d.doc_id""")
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and number of links of every document."""
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, percent=90)


@register(r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner of every document's normalised text."""
    return dedup.verdicts(table(spark, sf_dir, "documents"))


@register()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return toxicity.score(docs, scorer).select("doc_id", held_out.alias("held_out"), "score",
                                               (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return langid.predict(docs, model).withColumn("held_out", held_out)


#: The conversation that the contract adds to the table.
PROBE = r"\### Assistant: </turn> ok"


def _escaped_sql(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_MARKER_SQL = " ".join(f"WHEN '{r}' THEN '{m}'" for r, m in chat.MARKERS.items())


@register(rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
f AS (
  SELECT *, CASE role {_MARKER_SQL} ELSE '{chat.OTHER}' || {_escaped_sql('role')} || '{chat.SEPARATOR}' END
            || {_escaped_sql('text')} || '{chat.END}' AS shown FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, sha256(text))) AS loss_sha256,
       CAST(sum(length(shown)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""")
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted to tokens and read back from them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    path = vocabulary_path()
    return chat.read_back(chat.format_turns(turns.unionByName(probe), path), path).drop("n_tokens")


@register()
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@register()
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document's pieces in sequences of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def _repair_sql() -> str:
    """The damage, and a recursive DP that carries (cost, audit, lines) of each state."""
    solid = f"regexp_replace(text, '{repair.SPACE}', '', 'g')"

    def cell(*options: str) -> str:
        return "list_sort([" + ", ".join(options) + "])[1]"

    def edit(s: str, cost: str, letter: str, line: str | None = None, when: str = "true") -> str:
        lines = f"{s}.lines" if line is None else f"list_append({s}.lines, {line})"
        return (f"CASE WHEN {when} THEN {{'cost': {s}.cost + {cost}, 'audit': {s}.audit || '{letter}', 'lines': {lines}}} "
                "ELSE {'cost': 1000000000::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} END")

    def insert(s: str, role: str) -> str:
        return edit(s, "2", "I", f"'{role}:'")

    def row(s: str, state: int) -> list[str]:
        """Keep and rerole, from a state before that lets the role of ``state`` follow."""
        first = " sua"[state]
        kept = edit(s, "cut", "K", "role || ':' || text", f"NOT goes AND role[1] = '{first}'")
        return [kept] if state == 1 else [kept, edit(s, "2 + cut", "R", f"'{repair.ROLES[state]}:' || text", "NOT goes")]

    u2 = cell("s2", insert("s0", "user"), insert("s1", "user"), insert("s3", "user"))
    closed = f"{u2} AS z2, {cell('s3', insert(u2, 'assistant'))} AS z3"
    start = "{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}"
    none = "{'cost': 1000000000::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}"
    return f"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
shown AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (
  SELECT s.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                              lambda a, x: xor(a >> 8, crc.t[1 + (xor(a, x) & 255)])), 4294967295) % 20 AS h
  FROM shown s, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, {solid} AS solid FROM hurt),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copies FROM placed),
f AS (
  SELECT *, solid = '' AS blank, solid <> '' AND copies > 1 AS duplicate, solid = '' OR copies > 1 AS goes,
         CAST(solid <> '' AND copies = 1 AND solid[-1] NOT IN ('.', '!', '?') AS BIGINT) AS cut,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM counted),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
         sum(cut) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {start} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM f
  UNION ALL
  SELECT c.conv_id, f.i, {edit('s0', '3', 'D')}, {cell(edit('s1', '3', 'D'), *row('s0', 1))},
         {cell(edit('z2', '3', 'D'), *row('s0', 2), *row('s1', 2), *row('z3', 2))}, {cell(edit('z3', '3', 'D'), *row('z2', 3))}
  FROM (SELECT *, {closed} FROM dp) c JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i + 1),
done AS (
  SELECT conv_id, gaps, blank, duplicate, truncated, illegal, list_sort([s0, z3])[1] AS best
  FROM (SELECT *, {closed} FROM dp) JOIN sums USING (conv_id) WHERE i = n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""


@register(_repair_sql())
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every damaged conversation."""
    turns = table(spark, sf_dir, "conversations")
    found = repair.digests(repair.damaged(turns)).withColumnRenamed("conv_id", "_conv")
    all_ids = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    numbers = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = {**numbers, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return (all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
            .select("conv_id", *(F.coalesce(c, F.lit(x).cast("bigint") if c in numbers else F.lit(x)).alias(c) for c, x in nothing.items())))


@register(r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT *, len(lines) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(lines) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(lines) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100
              THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT *, array_to_string(lines[1:least(x, y)], '') AS prefix, array_to_string(lines[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(lines[greatest(x, y) + 1:n], '') AS suffix FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""")
def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, and restored from its output and form."""
    return fim.digests(table(spark, sf_dir, "documents"))


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    import corpus_pipeline
    oracle = dict(ORACLE)
    if corpus_pipeline.ORACLE_SQL is not None:
        oracle["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**QUERIES, "pipeline": corpus_pipeline.run}, oracle
