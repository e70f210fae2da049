"""The queries' SQL for DuckDB, written from what the operators should do and sharing nothing with their code."""

from __future__ import annotations

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WS1 = r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _re(x: str, *steps: tuple[str, str], options: str = "g") -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', {by}, '{options}')"
    return x


def _strip(x: str) -> str:
    return _re(x, (r"<[^>]+>", "''"), (r"&[a-zA-Z]+;", "' '"), (r"&#[0-9]+;", "' '"))


def _trim(x: str) -> str:
    return _re(x, (rf"^[{_WS}]+|[{_WS}]+$", "''"))


def _tidy(x: str) -> str:
    x = _re(x, (r"\n\n\n+", r"E'\n\n'"))
    return _trim(_re(x, (rf"(?m)^[{_WS1}]+|[{_WS1}]+$", "''"), (r"[ \t][ \t]+", "' '")))


def _boiler(x: str) -> str:
    s = f"[{_WS}]*"
    rules = ["cookie.*?kabul", "çerez.*?politika", "gizlilik.*?sözleşme", "tüm hakları saklıdır", "all rights reserved", f"©{s}[0-9][0-9][0-9][0-9]", "paylaş.*?(facebook|twitter|whatsapp)", f"yorum{s}yap", rf"yorumlar{s}\([0-9]+\)", "reklam", "advertisement", r"loading\.\.\.", f"devamını{s}oku", f"daha{s}fazla{s}göster"]
    return _re(x, *((r, "''") for r in rules), options="gi")


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{_WS}]+'), lambda u: u <> '')"


def _fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def _norm(x: str) -> str:
    return _trim(_re(_fold(x), (rf"[{_WS}]+", "' '")))


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({_fold(x)}, '[^\p{{L}}\p{{N}}_]+'), lambda u: u <> '')"


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(^|[^0-9])({_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET})($|[^0-9])"
_SEP, _SEP1 = rf"[{_WS}().-]*", rf"[{_WS}.-]*"
_TEL = rf"(^|[^0-9])((?:\+?90{_SEP})?0?[2-5][0-9][0-9]{_SEP}[0-9][0-9][0-9]{_SEP1}[0-9][0-9]{_SEP1}[0-9][0-9])($|[^0-9])"
_MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
_EMAIL = "regexp_replace({}, '" + _MAIL.replace("{", "{{").replace("}", "}}") + "', '<EMAIL>', 'g')"


def _pii(x: str) -> str:
    x = _EMAIL.format(x)
    return _re(x, (_IP, r"'\1<IP_ADDRESS>\3'"), (_IP, r"'\1<IP_ADDRESS>\3'"), (_TEL, r"'\1<PHONE>\3'"), (_TEL, r"'\1<PHONE>\3'"))


def _count(x: str, label: str) -> str:
    return f"((length({x}) - length(replace({x}, '<{label}>', ''))) // {len(label) + 2})"


_ID = r"""len(list_filter(regexp_extract_all({}, '[0-9]+'), lambda u: length(u) = 11 AND u[1] <> '0' AND (list_sum([try_cast(u[i] AS INTEGER) for i in [1, 3, 5, 7, 9]]) * 7 - list_sum([try_cast(u[i] AS INTEGER) for i in [2, 4, 6, 8]]) + 1000) % 10 = try_cast(u[10] AS INTEGER)
 AND list_sum([try_cast(u[i] AS INTEGER) for i in range(1, 11)]) % 10 = try_cast(u[11] AS INTEGER)))"""
_REDACTED = f"""SELECT doc_id, lang, t AS text, ({_count("t", "EMAIL")} - {_count("raw", "EMAIL")})::INTEGER AS email, ({_count("t", "IP_ADDRESS")} - {_count("raw", "IP_ADDRESS")})::INTEGER AS ip_address, ({_count("t", "PHONE")} - {_count("raw", "PHONE")})::INTEGER AS phone,
{_ID.format("t")}::INTEGER AS tckn FROM (SELECT doc_id, lang, text AS raw, {_pii("text")} AS t FROM documents)"""


def _quality(table: str, keep: str = "") -> str:
    """Signals of (doc_id, text and other columns) of a table expression."""
    breaks = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    return rf"""SELECT q.* EXCLUDE (a, u, m, s, text), round(a, 4) AS alpha_ratio, round(u, 4) AS unique_word_ratio, round(m, 4) AS average_word_length, round(s, 4) AS short_line_ratio,
coalesce(round(0.4::DOUBLE * greatest(0, least(1, (a - 0.35) / 0.4)) + 0.3::DOUBLE * least(u / 0.5, 1) + 0.2::DOUBLE * greatest(0, 1 - abs(m - 6) / 12) + 0.1::DOUBLE * (1 - s), 4), 0) AS quality_score {keep} FROM
(SELECT f.* EXCLUDE (ws, ls), len(ws)::INTEGER AS word_count, CASE WHEN len(ws) > 0 THEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / length(text) END AS a, CASE WHEN len(ws) > 0 THEN len(list_distinct(list_transform(ws, lambda w: {_fold("w")}))) / len(ws) END AS u,
CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda w: length(w)))::DOUBLE / len(ws) END AS m, CASE WHEN len(ws) > 0 THEN len(list_filter(ls, lambda x: len({_words("x").replace("lambda u: u", "lambda y: y")}) < 3)) / greatest(len(ls), 1) END AS s
FROM (SELECT b.*, {_words("text")} AS ws, list_filter(string_split_regex(text, '{breaks}'), lambda x: {_re("x", (rf"[{_WS}]+", "''"))} <> '') AS ls FROM {table} AS b) AS f) AS q"""


_CLEANED = f"(SELECT doc_id, lang, {_pii(_tidy(_boiler(_strip('text'))))} AS text, NULL AS dummy FROM documents)"
_GATES = "CASE WHEN word_count < 50 THEN 'too_short' WHEN word_count > 100000 THEN 'too_long' WHEN NOT (quality_score >= 0.5 AND alpha_ratio >= 0.5 AND unique_word_ratio >= 0.1 AND average_word_length BETWEEN 2 AND 25) THEN 'bad_quality' END"
_GATED = f"SELECT *, {_GATES} AS reject_reason FROM ({_quality(_CLEANED)})"

_GRAMS = f"""d AS (SELECT doc_id, source, lang, {_tokens("text")} AS ws FROM documents), b AS (SELECT item_id, {_tokens("text")} AS ws FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
bg AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM b)),
hit AS (SELECT doc_id, item_id, count(*) AS hits FROM dg JOIN bg USING (g) GROUP BY ALL HAVING count(*) >= 2)"""

def _simhash(cut: str = "") -> str:
    return f"""tok AS (SELECT doc_id, {_tokens("text")} AS ws FROM documents),
feat AS (SELECT doc_id, unnest((CASE WHEN len(ws) < 3 THEN ws ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END){cut}) AS f FROM tok),
vote AS (SELECT doc_id, concat('0x', substr(md5(f), 1, 16))::UBIGINT AS v FROM feat),
bits AS (SELECT doc_id, k, CASE WHEN sum(((v >> k) & 1)::INTEGER) * 2 >= count(*) THEN 1::UBIGINT << k ELSE 0::UBIGINT END AS b FROM vote, (SELECT unnest(range(64))::UBIGINT AS k) GROUP BY doc_id, k),
sim AS (SELECT doc_id, coalesce(x, 18446744073709551615::UBIGINT) AS x FROM documents LEFT JOIN (SELECT doc_id, sum(b)::UBIGINT AS x FROM bits GROUP BY 1) USING (doc_id))"""


def _hex(x: str) -> str:
    return f"lower(lpad(to_hex({x}), 16, '0'))"


_NAMES = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'wiki' WHEN 1 THEN 'wikipedia' WHEN 2 THEN 'fineweb2' WHEN 3 THEN 'culturax' WHEN 4 THEN 'sample' ELSE source END AS given FROM documents"
_PROFILE = f"""reg(source, dataset_id, dataset_revision, licenses, license_status, license_url, terms_url) AS (VALUES
 ('wiki', 'wikimedia/wikipedia', '20231101.tr', 'GFDL-unspecified,CC-BY-SA-3.0', 'verified_dataset_card', 'https://huggingface.co/datasets/wikimedia/wikipedia', NULL),
 ('fineweb2', 'HuggingFaceFW/fineweb-2', 'main', 'ODC-By-1.0', 'verified_dataset_card', 'https://huggingface.co/datasets/HuggingFaceFW/fineweb-2', 'https://commoncrawl.org/terms-of-use'),
 ('culturax', 'uonlp/CulturaX', 'main', 'UPSTREAM-mC4,UPSTREAM-OSCAR', 'inherited_review_required', 'https://huggingface.co/datasets/uonlp/CulturaX', NULL),
 ('sample', 'granary/generated-samples', 'local', 'Apache-2.0', 'project_owned', 'LICENSE', NULL)),
named AS (SELECT doc_id, given, CASE WHEN given IN ('wikipedia', 'wikipedia_tr', 'wikimedia/wikipedia') THEN 'wiki' ELSE given END AS source FROM ({_NAMES})),
prof AS (SELECT doc_id, named.source, coalesce(dataset_id, nullif(given, ''), 'unknown') AS dataset_id, coalesce(dataset_revision, 'unknown') AS dataset_revision, coalesce(licenses, '') AS licenses, coalesce(license_status, 'review_required') AS license_status, license_url, terms_url
 FROM named LEFT JOIN reg USING (source))"""

_AUDIT = f"""f AS (SELECT doc_id, lang || '.jsonl' AS file, doc_id % 50 = 7 AS bad, doc_id % 10 = 3 AS no_status, doc_id % 4 = 1 AS no_time, doc_id % 7 = 0 AS other_schema, doc_id % 3 = 0 AS redacted, doc_id % 17 = 0 AS contaminated,
 CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 5 = 0 THEN 'review_required' WHEN doc_id % 5 = 1 THEN 'inherited_review_required' ELSE 'verified_dataset_card' END AS status,
 CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '0' ELSE sha256({_norm("text")}) END AS digest, doc_id % 13 <> 0 AND doc_id % 11 = 0 AS wrong FROM documents)"""

_TEXTS = "(SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)"
_IDS = f"SELECT doc_id, source, list_transform({_words('text')}, lambda w: length(w)) AS ids FROM {_TEXTS}"
_RESULTS = "r AS (SELECT doc_id AS id, lang AS category, source AS benchmark, quality::DOUBLE AS score, quality = 1 AS correct, toxic::DOUBLE AS toxic FROM labels JOIN documents USING (doc_id))"
_VOWEL = "aeıioöuüAEIİOÖUÜ"


def _last_vowel(x: str, first: bool = False) -> str:
    pattern = f"([{_VOWEL}])" if first else f"([{_VOWEL}])[^{_VOWEL}]*$"
    return f"CASE WHEN regexp_extract({x}, '{pattern}', 1) = '' THEN 2 WHEN contains('aıouAIOU', regexp_extract({x}, '{pattern}', 1)) THEN 0 ELSE 1 END::INTEGER"


def _features(x: str) -> str:
    """Of a word or piece without its mark."""
    return rf"""{_last_vowel(x)} AS last_vowel, {_last_vowel(x, True)} AS first_vowel,
(regexp_extract(lower({x}), '(\p{{L}})\P{{L}}*$', 1) <> '' AND contains('fstkçşhp', regexp_extract(lower({x}), '(\p{{L}})\P{{L}}*$', 1))) AS voiceless_end,
(regexp_extract(lower({x}), '(\p{{L}})', 1) <> '' AND contains('cdg', regexp_extract(lower({x}), '(\p{{L}})', 1))) AS mutable_start"""


_PIECES = f"""w0 AS (SELECT item_id AS seq_id, {_words("lower(text)")} AS ws FROM benchmark),
w1 AS (SELECT seq_id, unnest(ws) AS word, unnest(range(len(ws))) AS w FROM w0),
p1 AS (SELECT seq_id, w, word, unnest(range((length(word) + 2) // 3)) AS p FROM w1),
seq AS (SELECT seq_id, w * 100000 + p AS pos, CASE WHEN p = 0 THEN '▁' ELSE '' END || substr(word, p * 3 + 1, 3) AS piece FROM p1),
voc AS (SELECT DISTINCT piece, ('0x' || substr(md5(piece), 1, 7))::BIGINT + 100 AS token_id, regexp_replace(piece, '^▁+', '') AS bare FROM seq),
feat AS (SELECT token_id, piece, {_features("bare")}, starts_with(piece, '▁') AS word_start, CASE WHEN piece LIKE '<%>' THEN 0 ELSE length(regexp_replace(piece, '[^{_VOWEL}]', '', 'g')) END::INTEGER AS syllables,
 CASE WHEN piece LIKE '<%>' THEN '' ELSE lower(right(regexp_replace(piece, '[^\\p{{L}}]', '', 'g'), 2)) END AS ending, CASE WHEN starts_with(piece, '▁') THEN 'root' ELSE 'suffix' END AS role,
 CASE WHEN NOT regexp_matches(piece, '\\p{{L}}') THEN 2 WHEN starts_with(piece, '▁') THEN 0 ELSE 1 END::INTEGER AS morphology FROM voc),
rhy AS (SELECT ending, row_number() OVER (ORDER BY min(token_id)) AS rhyme_class FROM feat WHERE ending <> '' GROUP BY ending),
tf AS (SELECT feat.*, coalesce(rhyme_class, 0)::INTEGER AS rhyme_class FROM feat LEFT JOIN rhy USING (ending))"""
_ANSWER = rf"trim(regexp_replace({_fold(chr(123) + chr(125))}, '[^\p{{{{L}}}}\p{{{{N}}}}_]+', ' ', 'g'))"


def _answer(x: str) -> str:
    return _ANSWER.format(f"replace(replace({x}, 'İ', 'i'), 'I', 'ı')")


_SKIP = r"(?i)^(?:.*\.(?:jpg|jpeg|png|gif|svg|ico|css|js|woff|ttf|pdf|zip|rar)$|.*/login|.*/register|.*/admin|.*\?.*page=[0-9]+$)"

ORACLES = {
    "html_strip": f"SELECT page_id, {_strip('html')} AS page_text FROM pages",
    "page_text": f"SELECT page_id, {_tidy(_strip('html'))} AS page_text FROM pages",
    "nfkc": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
    "boilerplate_strip": f"SELECT doc_id, {_boiler('text')} AS text FROM documents",
    "whitespace_clean": f"SELECT doc_id, {_tidy('text')} AS text FROM documents",
    "word_count": f"SELECT doc_id, len({_words('text')})::INTEGER AS words FROM documents",
    "length_gate": f"SELECT doc_id, CASE WHEN n < 50 THEN 'too_short' WHEN n > 1000 THEN 'too_long' END AS reject_reason FROM (SELECT doc_id, len({_words('text')}) AS n FROM documents)",
    "download_gate": f"SELECT source, count(*) AS docs FROM documents WHERE len({_words('text')}) BETWEEN 30 AND 100000 GROUP BY source",
    "crawl_gate": f"SELECT doc_id FROM documents WHERE len({_words('text')}) >= 50 AND coalesce(lang = 'de', true)",
    "clean_prefix": f"SELECT doc_id, text, word_count, quality_score, reject_reason FROM (SELECT g.*, c.text FROM ({_GATED}) AS g JOIN {_CLEANED} AS c USING (doc_id))",
    "quality_gate_funnel": f"SELECT coalesce(reject_reason, 'passed') AS reason, count(*) AS docs FROM ({_GATED}) GROUP BY 1",
    "pii_redaction": f"SELECT doc_id, text, email, ip_address, phone, tckn FROM ({_REDACTED})",
    "pii_counts_by_lang": f"SELECT lang, sum(email)::BIGINT AS email, sum(ip_address)::BIGINT AS ip_address, sum(phone)::BIGINT AS phone, sum(tckn)::BIGINT AS tckn, count(*) FILTER (email + ip_address + phone + tckn > 0) AS docs FROM ({_REDACTED}) GROUP BY lang",
    "norm_hash": f"SELECT doc_id, sha256({_norm('text')}) AS content_sha256 FROM documents",
    "exact_dedup": f"SELECT sha256({_norm('text')}) AS content_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "exact_dup_groups": f"SELECT sha256({_norm('text')}) AS content_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "simhash_md5": f"WITH {_simhash('[1:4096]')} SELECT doc_id, {_hex('x')} AS simhash64 FROM sim",
    "simhash_md5_pairs": f"WITH {_simhash()}, u AS (SELECT DISTINCT x, {_hex('x')} AS h, (CASE WHEN x >= 9223372036854775808::UBIGINT THEN x::HUGEINT - 18446744073709551616::HUGEINT ELSE x::HUGEINT END) AS o FROM sim) SELECT a.h AS a, b.h AS b FROM u AS a JOIN u AS b ON a.o < b.o WHERE bit_count(xor(a.x, b.x)) <= 3",
    "quality_signals": _quality("(SELECT doc_id, coalesce(text, '') AS text FROM documents)"),
    "quality_vs_label": f"SELECT l.quality, l.toxic, q.quality_score >= 0.5 AND coalesce(alpha_ratio >= 0.5 AND unique_word_ratio >= 0.1 AND average_word_length BETWEEN 2 AND 25, false) AS good, count(*) AS docs FROM ({_quality('(SELECT doc_id, text FROM documents)')}) AS q JOIN labels AS l USING (doc_id) GROUP BY ALL",
    "quality_by_source": f"SELECT source, round(avg(quality_score), 3) AS quality_score, round(avg(alpha_ratio), 3) AS alpha_ratio, round(avg(unique_word_ratio), 3) AS unique_word_ratio, round(avg(average_word_length), 3) AS average_word_length, round(avg(short_line_ratio), 3) AS short_line_ratio FROM ({_quality('(SELECT doc_id, source, text FROM documents)')}) GROUP BY source",
    "shingle_stats": f"SELECT doc_id, len(w)::INTEGER AS tokens, greatest(len(w) - 12, 0)::INTEGER AS grams FROM (SELECT doc_id, {_tokens('text')} AS w FROM documents)",
    "contamination": f"WITH {_GRAMS} SELECT * FROM hit",
    "contamination_matches": f"WITH {_GRAMS} SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS matches FROM hit GROUP BY doc_id",
    "contamination_reject": f"WITH {_GRAMS} SELECT source, count(*) AS docs FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit) GROUP BY source",
    "contamination_flag": f"WITH {_GRAMS} SELECT lang, count(*) AS docs, count(*) FILTER (doc_id IN (SELECT doc_id FROM hit)) AS flagged FROM documents GROUP BY lang",
    "benchmark_records": "SELECT item_id || ':text' AS record_id, text FROM benchmark WHERE text <> '' UNION ALL SELECT record_id, text FROM (SELECT item_id || ':choices:' || unnest(range(3)) AS record_id, unnest([split_part(text, ' ', 1), split_part(text, ' ', 2), regexp_replace(text, '^[^ ]* [^ ]* ', '')]) AS text FROM benchmark) WHERE text <> ''",
    "source_profile": f"WITH {_PROFILE} SELECT * FROM prof",
    "license_status_counts": f"WITH {_PROFILE} SELECT license_status, count(*) AS docs FROM prof GROUP BY 1",
    "source_counts": f"WITH {_PROFILE} SELECT source, count(*) AS docs FROM prof GROUP BY 1",
    "provenance": "SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'v' ELSE 'u' END AS source_url, doc_id::VARCHAR AS source_record_id, 'granary-document-1' AS schema_version, NULL::VARCHAR AS downloaded_at FROM documents",
    "audit_totals": f"""WITH {_AUDIT} SELECT count(*) AS lines, count(*) FILTER (bad) AS invalid_json, count(*) FILTER (NOT bad AND (no_status OR no_time)) AS missing_metadata, count(*) FILTER (NOT bad AND other_schema) AS schema_mismatch,
 count(*) FILTER (NOT bad AND status LIKE '%review_required') AS license_review_required, count(*) FILTER (NOT bad AND redacted) AS pii_redacted_documents, count(*) FILTER (NOT bad AND contaminated) AS contaminated_documents, count(*) FILTER (NOT bad AND wrong) AS hash_mismatch,
 count(digest) FILTER (NOT bad) - count(DISTINCT digest) FILTER (NOT bad) AS duplicate_hashes FROM f""",
    "audit_missing_fields": f"WITH {_AUDIT} SELECT 'license_status' AS field, count(*) AS lines FROM f WHERE NOT bad AND no_status UNION ALL SELECT 'downloaded_at', count(*) FROM f WHERE NOT bad AND no_time",
    "audit_per_file": f"WITH {_AUDIT} SELECT file, count(*) AS lines, count(*) FILTER (bad) AS invalid_json FROM f GROUP BY file",
    "audit_license_statuses": f"WITH {_AUDIT} SELECT coalesce(status, 'missing') AS license_status, count(*) AS lines FROM f WHERE NOT bad GROUP BY 1",
    "corpus_report": f"SELECT source, lang, count(*) AS docs, sum(w)::BIGINT AS words, sum(c)::BIGINT AS chars, count(*) FILTER (w = 0) AS empty FROM (SELECT source, lang, len({_words('text')}) AS w, length(text) AS c FROM documents) GROUP BY GROUPING SETS ((source, lang), (source), ())",
    "output_sizes": "SELECT source, count(*) AS docs, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes FROM documents GROUP BY source",
    "corpus_fingerprint": "WITH h AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 4096 AS b, doc_id, sha256(doc_id::VARCHAR || chr(0) || text) AS h FROM documents), g AS (SELECT b, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM h GROUP BY b) SELECT CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY b)) END AS sha256 FROM g",
    "train_eval_split": f"SELECT doc_id, CASE WHEN ('0x' || substr(md5('42:' || {_norm('text')}), 1, 8))::BIGINT % 1000000 < 50000 THEN 'eval' ELSE 'train' END AS split FROM documents",
    "split_counts": "SELECT CASE WHEN ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 1000000 < 100000 THEN 'eval' ELSE 'train' END AS split, count(*) AS docs, count(DISTINCT doc_id) AS ids FROM documents GROUP BY 1",
    "token_offsets": f"SELECT doc_id, n, first_token, first_token // 2048 AS first_block FROM (SELECT doc_id, n::INTEGER AS n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_token FROM (SELECT doc_id, len({_words('text')}) AS n FROM {_TEXTS}))",
    "shard_offsets": f"SELECT source, doc_id, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_token FROM (SELECT source, doc_id, len({_words('text')}) AS n FROM {_TEXTS})",
    "shard_assign": f"WITH t AS (SELECT (row_number() OVER (ORDER BY doc_id, p) - 1) // 10000 AS shard_id, id FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS p FROM ({_IDS}))) SELECT shard_id, count(*) AS tokens, sum(id)::BIGINT AS total FROM t GROUP BY shard_id",
    "shard_manifest": f"WITH t AS (SELECT source AS grp, (row_number() OVER (PARTITION BY source ORDER BY doc_id, p) - 1) // 5000 AS shard_id FROM (SELECT doc_id, source, unnest(range(len(ids))) AS p FROM ({_IDS}))) SELECT grp, shard_id, count(*) AS tokens, greatest(0, (count(*) - 1) // 64) AS blocks FROM t GROUP BY ALL",
    "pack_blocks": f"""WITH t AS (SELECT row_number() OVER (ORDER BY doc_id, p) - 1 AS n, id FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS p FROM ({_IDS}))),
 e AS (SELECT n // 128 AS block_id, n, id FROM t UNION ALL SELECT n // 128 - 1, n, id FROM t WHERE n % 128 = 0 AND n > 0),
 g AS (SELECT block_id, list(id ORDER BY n) AS x FROM e GROUP BY block_id HAVING count(*) = 129) SELECT block_id, array_to_string(x[1:128], ' ') AS input_ids, array_to_string(x[2:129], ' ') AS labels FROM g""",
    "pack_framed": f"""WITH t AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, p) - 1 AS n, count(*) OVER (PARTITION BY source) AS c, id FROM (SELECT doc_id, source, unnest(list_concat([2], ids, [3])) AS id, unnest(range(len(ids) + 2)) AS p FROM ({_IDS})))
 SELECT source, any_value((c - 1) // 256)::BIGINT AS blocks, sum(id)::BIGINT AS total FROM t WHERE n >= 1 AND n <= ((c - 1) // 256) * 256 GROUP BY source""",
    "locate_blocks": f"""WITH t AS (SELECT source AS grp, (row_number() OVER (PARTITION BY source ORDER BY doc_id, p) - 1) // 5000 AS shard_id FROM (SELECT doc_id, source, unnest(range(len(ids))) AS p FROM ({_IDS}))),
 m AS (SELECT grp, shard_id, greatest(0, (count(*) - 1) // 64) AS blocks FROM t GROUP BY ALL), b AS (SELECT grp, shard_id, unnest(range(blocks)) AS local_block FROM m)
 SELECT row_number() OVER (ORDER BY grp, shard_id, local_block) - 1 AS block_index, grp, shard_id, local_block FROM b""",
    "batches": "SELECT doc_id // 16 AS batch, string_agg(n_chars::VARCHAR, ' ' ORDER BY doc_id) AS items FROM documents GROUP BY 1",
    "padded": f"SELECT doc_id, array_to_string(list_concat(ids[1:20], list_transform(range(m - len(ids[1:20])), lambda i: 0)), ' ') AS ids, array_to_string(list_concat(list_transform(ids[1:20], lambda i: 1), list_transform(range(m - len(ids[1:20])), lambda i: 0)), ' ') AS mask FROM (SELECT *, max(least(len(ids), 20)) OVER () AS m FROM ({_IDS}))",
    "byte_budget": "SELECT doc_id, bytes_before FROM (SELECT doc_id, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before FROM documents) WHERE bytes_before < 500000",
    "mixture_weights": "WITH g(grp, a, b) AS (VALUES ('general', 0.2::DOUBLE, 0.6::DOUBLE), ('high_quality', 0.8::DOUBLE, 0.4::DOUBLE)), l AS (SELECT step, grp, a + (b - a) * least(step / 100, 1) AS raw FROM g, (SELECT unnest(range(0, 151, 10)) AS step)) SELECT step, grp, round(raw / sum(raw) OVER (PARTITION BY step), 6) AS weight FROM l",
    "mixture_groups": "SELECT CASE WHEN source IN ('source_1', 'source_2', 'src1', 'src2') THEN 'high_quality' ELSE 'general' END AS grp, count(*) AS docs FROM documents GROUP BY 1",
    "schedules": """SELECT step, round(CASE WHEN step < 100 THEN 3e-4 * (step + 1) / 100 WHEN step >= 1000 THEN 3e-5 ELSE 3e-5 + 0.5 * (3e-4 - 3e-5) * (1 + cos(pi() * (step - 100) / 900)) END, 10) AS rate,
 round(CASE WHEN step <= 50 THEN 0.0 ELSE 0.1::DOUBLE * least(1.0::DOUBLE, (step - 50) / 200.0::DOUBLE) END, 8) AS aux_weight, round(1 + 0.5::DOUBLE * least(1.0::DOUBLE, step / 400.0::DOUBLE), 8) AS suffix_weight, ((step + 63) // 64 * 64)::BIGINT AS padded FROM (SELECT unnest(range(0, 1201)) AS step)""",
    "category_report": f"WITH {_RESULTS} SELECT 'category' AS scope, category AS name, count(*) AS count, avg(score) AS mean_score, count(*) FILTER (correct) AS correct FROM r GROUP BY category UNION ALL SELECT 'benchmark', benchmark, count(*), avg(score), count(*) FILTER (correct) FROM r GROUP BY benchmark",
    "micro_macro": f"WITH {_RESULTS} SELECT (SELECT count(*) FROM r) AS samples, round((SELECT avg(score) FROM r), 9) AS micro_score, round((SELECT avg(m) FROM (SELECT avg(score) AS m FROM r GROUP BY category)), 9) AS macro_score, (SELECT count(*) FROM r WHERE correct) AS correct",
    "category_comparison": f"WITH {_RESULTS}, a AS (SELECT category, avg(score) AS x FROM r GROUP BY 1), b AS (SELECT category, avg(1 - toxic) AS y FROM r WHERE category <> 'fr' GROUP BY 1) SELECT category, round(x, 9) AS current, round(y, 9) AS baseline, round(x - y, 9) AS delta FROM a FULL JOIN b USING (category)",
    "paired_deltas": f"WITH {_RESULTS} SELECT id, category, 1 - toxic AS baseline, score AS candidate, score - (1 - toxic) AS delta FROM r",
    "win_tie_loss": f"WITH {_RESULTS}, d AS (SELECT category, score - (1 - toxic) AS delta FROM r) SELECT category, count(*) AS samples, round(avg(delta), 9) AS mean_delta, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses FROM d GROUP BY GROUPING SETS ((category), ())",
    "id_differences": f"WITH {_RESULTS} SELECT id, 'extra' AS side FROM r WHERE category = 'fr'",
    "top_scores": "SELECT source, doc_id, n_chars AS score FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS k FROM documents) WHERE k <= 3",
    "nucleus": "WITH p AS (SELECT source, doc_id AS token_id, n_chars / sum(n_chars) OVER (PARTITION BY source) AS prob FROM documents), c AS (SELECT *, sum(prob) OVER (PARTITION BY source ORDER BY prob DESC, token_id ROWS UNBOUNDED PRECEDING) AS upto FROM p) SELECT source, token_id FROM c WHERE upto - prob <= 0.5",
    "banned_next": f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(x) - 1), lambda i: x[i:i + 1] = x[len(x) - 1:len(x)]), lambda i: x[i + 2]))), ' ') AS banned FROM (SELECT doc_id, ids[1:300] AS x FROM ({_IDS}))",
    "answer_forms": f"SELECT conv_id, turn, {_answer('text')} AS form FROM conversations",
    "prefix_leak": f"WITH t AS (SELECT conv_id, turn, {_answer('text')} AS form FROM conversations), b AS (SELECT *, lag(form) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t), c AS (SELECT *, len(list_filter(range(1, least(length(form), length(before)) + 1), lambda i: left(form, i) = left(before, i)))::INTEGER AS common FROM b WHERE before IS NOT NULL) SELECT conv_id, turn, common, form = before OR common / greatest(length(before), 1) >= 0.8 AS leaked FROM c",
    "keyword_scan": f"SELECT conv_id, turn, array_to_string(list_filter(['the', 'code', 'please', 'data'], lambda k: contains(form, k)), ',') AS found FROM (SELECT conv_id, turn, {_answer('text')} AS form FROM conversations)",
    "token_length_percentiles": f"SELECT lang, count(*) AS docs, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.95) AS p95, max(n)::INTEGER AS longest FROM (SELECT lang, len({_words('text')}) AS n FROM {_TEXTS}) GROUP BY lang",
    "domain_stats": rf"""WITH t AS (SELECT lang AS domain, text, {_words("text")} AS p FROM {_TEXTS}), f AS (SELECT domain, len(regexp_extract_all(text, '[\p{{L}}\p{{No}}\p{{Nl}}]+(?:[''’][\p{{L}}\p{{No}}\p{{Nl}}]+)?|\p{{Nd}}+')) AS w, length(array_to_string(p, '')) AS c, strlen(text) AS b, len(p) AS t,
 len(list_filter(p, lambda x: length(x) > 10)) AS u, len(list_filter(p, lambda x: regexp_matches(x, '^<0x[0-9A-Fa-f][0-9A-Fa-f]>$'))) AS y, (length(text) % 2 = 0)::INTEGER AS e FROM t)
 SELECT domain, grouping(domain)::INTEGER AS overall, count(*) AS documents, sum(w)::BIGINT AS words, sum(c)::BIGINT AS characters, sum(b)::BIGINT AS utf8_bytes, sum(t)::BIGINT AS tokens, round(sum(t) / sum(w), 9) AS tokens_per_word, round(sum(c) / sum(t), 9) AS characters_per_token, round(sum(b) / sum(t), 9) AS utf8_bytes_per_token,
 round(sum(u) / sum(t), 9) AS unknown_rate, round(sum(y) / sum(t), 9) AS byte_token_rate, round(sum(e) / count(*), 9) AS roundtrip_exact_rate, round(quantile_cont(t, 0.5), 9) AS document_tokens_p50, round(quantile_cont(t, 0.95), 9) AS document_tokens_p95, max(t)::INTEGER AS document_tokens_max FROM f GROUP BY GROUPING SETS ((domain), ())""",
    "vocabulary_metrics": rf"WITH {_PIECES} SELECT count(*) AS size, 0::BIGINT AS byte_pieces, count(*) FILTER (starts_with(piece, '▁')) AS word_start_pieces, count(*) FILTER (NOT starts_with(piece, '▁') AND regexp_matches(piece, '\p{{L}}')) AS continuation_pieces, count(*) FILTER (length(bare) = 1) AS single_character_pieces FROM voc",
    "word_features": rf"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({_words("lower(text)")}) AS word FROM {_TEXTS}) GROUP BY word) SELECT word, n, CASE WHEN word LIKE '<%>' THEN 0 ELSE length(regexp_replace(word, '[^{_VOWEL}]', '', 'g')) END::INTEGER AS syllable_count, {_features("word")}, CASE WHEN word LIKE '<%>' THEN '' ELSE lower(right(regexp_replace(word, '[^\p{{L}}]', '', 'g'), 2)) END AS ending FROM w""",
    "token_features": f"WITH {_PIECES} SELECT * FROM tf",
    "feature_inventory": f"""WITH {_PIECES} SELECT count(*) AS pieces, count(*) FILTER (first_vowel = 0) AS back_first, count(*) FILTER (first_vowel = 1) AS front_first, count(*) FILTER (first_vowel = 2) AS neutral_first, count(*) FILTER (word_start) AS word_starts, count(*) FILTER (voiceless_end) AS voiceless_ends,
 count(*) FILTER (mutable_start AND NOT word_start) AS mutable_suffixes, count(*) FILTER (role = 'root') AS roots, count(*) FILTER (role = 'suffix') AS suffixes, 0::BIGINT AS specials, count(*) FILTER (syllables >= 1) AS with_syllables, max(rhyme_class) AS rhyme_classes FROM tf""",
    "harmony_violation": f"WITH {_PIECES}, s AS (SELECT seq_id, first_vowel, word_start, lag(last_vowel) OVER (PARTITION BY seq_id ORDER BY pos) AS was FROM seq JOIN tf USING (piece)) SELECT seq_id, count(*) AS transitions, count(*) FILTER (first_vowel = 1 - was) AS violations FROM s WHERE NOT word_start AND was < 2 GROUP BY seq_id",
    "assimilation_violation": f"WITH {_PIECES}, s AS (SELECT seq_id, mutable_start, word_start, lag(voiceless_end) OVER (PARTITION BY seq_id ORDER BY pos) AS was FROM seq JOIN tf USING (piece)) SELECT seq_id, count(*) AS transitions, count(*) FILTER (mutable_start) AS violations FROM s WHERE NOT word_start AND was GROUP BY seq_id",
    "line_metre": rf"SELECT doc_id, line::INTEGER AS line, length(regexp_replace(t, '[^{_VOWEL}]', '', 'g'))::INTEGER AS syllables, lower(right(regexp_replace(t, '[^\p{{L}}]', '', 'g'), 2)) AS ending FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM {_TEXTS}) WHERE regexp_matches(t, '[^ \t\n\x0b\f\r]')",
    "turn_changes": f"SELECT conv_id, count(*) AS turns, count(*) FILTER (role <> was) AS role_changes, sum(w)::BIGINT AS words FROM (SELECT conv_id, role, len({_words('text')}) AS w, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations) GROUP BY conv_id",
    "page_url_skip": f"SELECT page_id, regexp_matches(url, '{_SKIP}') AS skip, regexp_matches(url || '/pic.PNG', '{_SKIP}') AS skip_file, regexp_matches(url || '?a=1&page=2', '{_SKIP}') AS skip_page FROM pages",
}
