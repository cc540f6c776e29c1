"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversation_repair, exact_dedup, html_text, jaccard_join, language_id, license_scan, media_tiff, mixing, packing, paragraph_dedup, quality_zstd, toxicity_crf
from .common import documents, fold, labels

#: A document is predicted to have label 1 from this score on.
LIMIT = 0.3


def op1_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), fold(F.col("doc_id"), 5) == 0
    found = quality_zstd.scored(docs, quality_zstd.fitted(docs, labels(spark, sf_dir), ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "finish", "ahead")


def op3_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_tiff.digests(media_tiff.stored_texts(documents(spark, sf_dir)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.deduplicated(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 4) == 2
    found = language_id.identified(docs, ~held_out & F.col("lang").isNotNull())
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), fold(F.col("doc_id"), 4) == 2
    found = toxicity_crf.scored(docs, toxicity_crf.fitted(docs, labels(spark, sf_dir), ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"), "spans")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repaired(rows, conversation_repair.damaged(rows))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top(collocations.scored(*collocations.counted(documents(spark, sf_dir))))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_zstd, op2_mixing, op3_media_tiff, op4_jaccard_join, op5_paragraph_dedup, op6_language_id, op7_toxicity_crf, op8_packing, op9_exact_dedup, op10_license_scan, op11_conversation_repair, op12_collocations, op13_html_text)}


_CRC = """list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length({x}) + 1), lambda k: [ascii(substr({x}, CAST(k AS INT), 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"""
#: The cheapest of several ways to go on (a cost, then its edits) as one text, which sorts as they do.
_WAY = "lpad(CAST({cost} AS VARCHAR), 12, '0') || {edits}"


def _onward(cost: int, letter: str, then: str, extra: str = "0") -> str:
    return _WAY.format(cost=f"(CAST(left({then}, 12) AS BIGINT) + {cost} + {extra})", edits=f"'{letter}' || substr({then}, 13)")


def _step(state: int) -> str:
    """What a row leaves best to do in a state, insertions before it left out."""
    new = {0: "q2", 1: "q2", 2: "q3", 3: "q2"}[state]
    keep = {0: "CASE init WHEN 's' THEN {s} WHEN 'u' THEN {u} END", 1: "CASE init WHEN 'u' THEN {u} END", 2: "CASE init WHEN 'a' THEN {a} END", 3: "CASE init WHEN 'u' THEN {u} END"}[state]
    kept = keep.format(s=_onward(0, "K", "q1", "cut"), u=_onward(0, "K", "q2", "cut"), a=_onward(0, "K", "q3", "cut"))
    return f"CASE WHEN gone THEN {_onward(3, 'D', f'q{state}')} ELSE least({_onward(3, 'D', f'q{state}')}, {kept}, {_onward(2, 'R', new, 'cut')}) END AS p{state}"


ORACLES = {
    "op11_conversation_repair": rf"""
WITH RECURSIVE hurt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(h, 4294967295) % 20 AS k
  FROM (SELECT *, {_CRC.format(x="x")} AS h FROM (SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS x FROM conversations))
), damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hurt, (VALUES (0), (1)) t(again) WHERE k <> 0 AND (again = 0 OR k = 3)
), numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS BIGINT) AS i, CAST(count(*) OVER (PARTITION BY conv_id) AS BIGINT) AS n, left(role, 1) AS init,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank
  FROM damaged
), repeats AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered
), faults AS MATERIALIZED (
  SELECT *, NOT blank AND again AS repeated, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, blank OR again AS gone,
    CASE WHEN NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS cut
  FROM repeats
), costs AS (
  SELECT conv_id, n AS i, '000000000000' AS q0, '000000000004II' AS q1, '000000000002I' AS q2, '000000000000' AS q3 FROM (SELECT DISTINCT conv_id, n FROM faults)
  UNION ALL
  SELECT conv_id, i, least(p0, {_onward(2, "I", "r2")}), least(p1, {_onward(2, "I", "r2")}), r2, r3
  FROM (SELECT *, least(p2, {_onward(2, "I", "p3")}) AS r2, least(p3, {_onward(2, "I", "p2")}) AS r3 FROM (
    SELECT c.conv_id, c.i - 1 AS i, {", ".join(_step(q) for q in range(4))} FROM costs c JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i))
), best AS (SELECT conv_id, CAST(left(q0, 12) AS BIGINT) AS cost, substr(q0, 13) AS audit FROM costs WHERE i = 0
), letters AS (
  SELECT *, length(replace(left(audit, k), 'I', '')) AS i, length(replace(left(audit, k), 'D', '')) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)
), said AS (
  SELECT l.conv_id, k, e, substr(audit, k, 1) AS edit, init, role, text FROM letters l JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE substr(audit, k, 1) IN ('K', 'R')
  UNION ALL SELECT conv_id, k, e, 'I', '', '', '' FROM letters WHERE substr(audit, k, 1) = 'I'
), led AS (SELECT *, max(CASE WHEN e = 1 AND edit = 'K' AND init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM said
), whole AS (
  SELECT conv_id, string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN (e - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', text), chr(10) ORDER BY k) AS t FROM led GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (repeated) AS duplicate, count(*) FILTER (open) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(init) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faults) GROUP BY conv_id
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents
), sizes AS (SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM pieces GROUP BY lang
), counted AS MATERIALIZED (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, range(1, 6) t(k) WHERE len(words) >= k) GROUP BY ALL HAVING count(*) >= 100
), candidates AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM counted WHERE k >= 2
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, l.f AS l, r.f AS r, n, head, (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS head FROM candidates) c JOIN sizes s ON s.lang = c.lang
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(words[1:head], ' ') JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(words[head + 1:], ' ')
), least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, head) = 1
), inner_of AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, words, a, m, unnest(range(1, k - m + 2)) AS i FROM candidates, range(2, 5) t(m) WHERE m < k) GROUP BY ALL
), kept AS (SELECT l.* FROM least l LEFT JOIN inner_of o ON o.lang = l.lang AND o.phrase = l.phrase WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
""",
    "op13_html_text": r"""
WITH main AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1)>') AS blocks FROM pages
), plain AS (
  SELECT page_id, url, list_filter(list_transform(blocks, lambda b: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda b: b <> '') AS blocks FROM main
)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM plain
""",
    "op2_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM sized GROUP BY source
), filling AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM totals)
             - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM totals
), goals AS (
  SELECT source, source_size, least(2.0 * source_size, (SELECT max(unit) FROM filling) * w) AS target FROM filling
), keyed AS (SELECT *, md5('mix:' || CAST(doc_id AS VARCHAR) || ':' || CAST(size AS VARCHAR)) AS key FROM sized
), queued AS (
  SELECT k.*, g.source_size, CAST(g.target AS DOUBLE) AS target,
         CAST(coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source
), copies AS (SELECT *, CAST(start + r * source_size + size AS DOUBLE) / nullif(target, 0) AS finish FROM queued, (VALUES (0), (1)) t(r)
), line AS (
  SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY finish NULLS LAST, source NULLS LAST, key, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM copies
)
SELECT doc_id, size, source_size, target, finish, ahead,
       CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) AS BIGINT) AS taken
FROM line WHERE r = 0
""",
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r USING (doc_id)
""",
    "op9_exact_dedup": r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), grouped AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM norm JOIN grouped USING (t)
""",
}
