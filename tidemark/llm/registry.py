"""The corpus queries, their SQL, and the thin digests that the queries return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    conversation_repair,
    decontaminate,
    exact_dedup,
    html_text,
    jaccard_join,
    line_dedup,
    lm_score,
    pii,
    quality,
    spelling_variants,
    substring_dedup,
    toxicity,
)


#: The vocabulary of the BPE queries.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.duplicate_factors(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_decoded=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.site_line_dedup(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_components(table(spark, sf_dir, "documents"), width=3, num=9, den=10)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d
), win AS (
  SELECT * FROM (SELECT doc_id, i, n, string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS s FROM words) WHERE i <= n - 12
), firsts AS (
  SELECT s, min(doc_id) AS f FROM win GROUP BY s
), dup AS (
  SELECT win.doc_id, win.i FROM win JOIN firsts ON win.s = firsts.s WHERE firsts.f < win.doc_id
), marked AS (
  SELECT words.doc_id, words.i, word, max((dup.i IS NOT NULL)::INT) OVER (
    PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN dup ON words.doc_id = dup.doc_id AND words.i = dup.i
), kept AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM marked GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w
  FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, i, n, string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM words) WHERE i <= greatest(1, n - 2)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, r.component_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of a text, four bits at a time."""
    digits = f"hex(encode({text}))"
    nibbles = f"list_transform(range(length({digits})), lambda i: instr('0123456789ABCDEF', substr({digits}, (i + (CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END))::INT, 1)) - 1)"
    # The table of the reflected polynomial 0xEDB88320 for four bits.
    table = (
        "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, "
        "3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
    )
    step = f"lambda c, x: xor(c >> 4, {table}[1 + (xor(c, x) & 15)])"
    return f"xor(list_reduce(list_prepend(4294967295, {nibbles})::BIGINT[], {step}), 4294967295)"


_TAGS = "|".join(line_dedup.BLOCK_TAGS)

OP8_SQL = rf"""
WITH p AS (
  SELECT page_id,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?s)<!--.*?-->', '', 'g'),
      '(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>', '', 'g'),
      '(?i)</?(?:{_TAGS})(?:[\s/][^>]*)?>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS body
  FROM pages
), q AS (
  SELECT page_id, host, list_filter(list_transform(string_split(body, chr(10)),
    lambda x: trim(regexp_replace(x, '[ \t-\r]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM p
), t AS (
  SELECT host, count(DISTINCT page_id) AS total FROM q GROUP BY host
), s AS (
  SELECT host, line, count(DISTINCT page_id) AS n
  FROM (SELECT page_id, host, unnest(lines) AS line FROM q) GROUP BY host, line
), b AS (
  SELECT s.host, list(s.line) AS gone FROM s JOIN t ON s.host = t.host
  WHERE s.n >= 3 AND s.n > 0.2 * t.total GROUP BY s.host
), k AS (
  SELECT q.page_id, q.host, q.lines,
    list_filter(q.lines, lambda x: NOT list_contains(coalesce(b.gone, []), x)) AS kept
  FROM q LEFT JOIN b ON q.host = b.host
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
  array_to_string(kept, chr(10)) AS text
FROM k
"""


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NEXT, _MAY = (2, 2, 3, 2), ("u", "u", "a", "u")
_X = "substr(sig, i::INT, 1)"


def _option(edit: str, cost: str, state: int) -> str:
    return f"{{'c': {cost} + f[{state + 1}].c, 'a': '{edit}' || f[{state + 1}].a}}"


def _solved(state: int) -> str:
    """SQL for the cheapest edits from a state on, (cost, audit), by what follows a row in each state (f) and its symbol."""
    cut = f"(CASE WHEN {_X} = upper({_X}) THEN 5 ELSE 0 END)"
    delete, rerole = _option("D", "2", state), _option("R", f"1 + {cut}", _NEXT[state])
    keep = f"CASE WHEN lower({_X}) = '{_MAY[state]}' THEN {_option('K', cut, _NEXT[state])}"
    keep += f" WHEN lower({_X}) = 's' THEN {_option('K', cut, 1)} END" if state == 0 else " END"
    return f"list_sort(CASE WHEN {_X} = 'x' THEN [{delete}] ELSE list_filter([{delete}, {rerole}, {keep}], lambda o: o IS NOT NULL) END)[1]"


def _inserted(column: str) -> str:
    each = (f"list_sort([{column}[{q + 1}], {{'c': 5 + {column}[{_NEXT[q] + 1}].c, 'a': 'I' || {column}[{_NEXT[q] + 1}].a}}])[1]" for q in range(4))
    return "[" + ", ".join(each) + "]"


_SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11_SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations
), dam AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src WHERE h <> 0
), ord AS (
  SELECT *, left(role, 1) AS r, rtrim(text, {_SPACES}) AS t,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS k,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i
  FROM dam
), sym AS (
  SELECT *, CASE WHEN t = '' THEN 'b' WHEN k > 1 THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f,
    CASE WHEN r IN ('s', 'u', 'a') THEN r ELSE 'o' END AS c, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS prev
  FROM ord
), conv AS (
  SELECT conv_id, string_agg(CASE WHEN f IN ('b', 'd') THEN 'x' WHEN f = 't' THEN upper(c) ELSE c END, '' ORDER BY i) AS sig,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
    count(*) FILTER (prev IS NOT NULL AND prev || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM sym GROUP BY conv_id
), solved AS (
  SELECT DISTINCT sig, length(sig) AS i, [{{'c': 0, 'a': ''}}, {{'c': 10, 'a': 'II'}}, {{'c': 5, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS f FROM conv
  UNION ALL
  SELECT sig, i - 1, {_inserted("g3")} FROM (
    SELECT sig, i, {_inserted("g2")} AS g3 FROM (
      SELECT sig, i, {_inserted("g1")} AS g2 FROM (
        SELECT sig, i, [{", ".join(map(_solved, range(4)))}] AS g1 FROM solved WHERE i > 0)))
), audit AS (
  SELECT sig, f[1].c AS cost, f[1].a AS audit FROM solved WHERE i = 0
), steps AS (
  SELECT conv_id, p, e, sum((e <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM (
    SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, substr(audit, p::INT, 1) AS e FROM conv JOIN audit ON conv.sig = audit.sig)
), left_over AS (
  SELECT steps.conv_id, p, e, row_number() OVER (PARTITION BY steps.conv_id ORDER BY p) AS j, sym.role, CASE WHEN e = 'I' THEN '' ELSE sym.text END AS text,
    first_value(e = 'K' AND sym.r = 's') OVER (PARTITION BY steps.conv_id ORDER BY p) AS headed
  FROM steps LEFT JOIN sym ON sym.conv_id IS NOT DISTINCT FROM steps.conv_id AND sym.i = steps.i WHERE e <> 'D'
), fixed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (j - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS s
  FROM left_over GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(s, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN conv ON conv.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audit ON audit.sig = conv.sig LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP13_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), sums AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM sums
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS (
  SELECT word, n, p, left(word, p::INT) AS a, substr(word, p::INT + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)
), pairs AS (
  SELECT x.word, y.word AS near, y.n FROM cuts x JOIN cuts y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT cuts.word, words.word, words.n FROM cuts JOIN words ON words.word = a || b
  UNION SELECT words.word, cuts.word, cuts.n FROM cuts JOIN words ON words.word = a || b
), best AS (
  SELECT word, count(*) AS n_near, list_sort(list({{'r': -n, 'w': near}}))[1] AS b FROM pairs GROUP BY word
), forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.r >= 2 * words.n THEN b.w END AS form,
    CASE WHEN -b.r >= 2 * words.n THEN (-b.r)::BIGINT END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word
), chain AS (
  SELECT word, word AS at, form FROM forms
  UNION ALL SELECT chain.word, forms.word, forms.form FROM chain JOIN forms ON forms.word = chain.form
)
SELECT forms.word, forms.form, chain.at AS root, n, n_near, form_n FROM forms JOIN chain ON chain.word = forms.word AND chain.form IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_quality": op2_quality,
        "op3_pii": op3_pii,
        "op4_decontamination": op4_decontamination,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_bpe": op7_bpe,
        "op8_line_dedup": op8_line_dedup,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_html_extraction": op10_html_extraction,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_toxicity": op12_toxicity,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_jaccard_join": OP9_SQL,
            "op11_conversation_repair": OP11_SQL, "op13_spelling_variants": OP13_SQL}
