"""The ``opN_*`` queries: each operator over its whole table, with the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, exact_dedup, fingerprints, langid, manifest, packing, secrets, simhash, substring_dedup, suffix_dedup, url_filter, whitening, wrappers
from tidemark.llm.common import ascii_lower, documents

URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicate(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir, "doc_id", "text"), secrets.BlobLedger(spark))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined, 256).alias("base_sha256"),
        joined.alias("spans"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with exact_dedup.DigestIndex(spark) as index:
        out = exact_dedup.deduplicate(documents(spark, sf_dir, "doc_id", "text"), index)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = langid.identify(docs.drop("lang"), langid.train_on_documents(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.edited_fingerprints(documents(spark, sf_dir, "doc_id", "text"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "edited_in_doc",
        "doc_in_next",
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", simhash.as_text(F.col("fp")).alias("fingerprint"), "component_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir, "doc_id", "text")))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(documents(spark, sf_dir, "doc_id", "text"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = whitening.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whitening.whiten(x, whitening.fit(x))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = manifest.leaf(["doc_id", "source", "lang", "n_chars", ascii_lower(F.col("text"))])
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    own = manifest.leaf()
    out = manifest.prove(documents(spark, sf_dir, *manifest.FIELDS), own, F.when(hit, changed).otherwise(own))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_fingerprints": op5_fingerprints,
    "op6_url_filter": op6_url_filter,
    "op7_simhash": op7_simhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_packing": op10_packing,
    "op11_html_text": op11_html_text,
    "op12_whitening": op12_whitening,
    "op13_manifest": op13_manifest,
}

_SQL_NAME = r"(?i:(password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?"


def _kind_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, '{kind}' AS kind, {rank} AS rank,
      unnest(list_filter(list_transform(range(1, len(hits) + 1), lambda i: struct_pack(
        s := coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0),
        n := length(hits[i]), v := length(vals[i]))), lambda x: x.v >= {least})) AS f
    FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits,
            regexp_extract_all(t, '{pattern}', {group}) AS vals
          FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


def _manifest_sql(levels: int = 5, top: int = 3) -> str:
    """The tree level by level, as far as 16**levels rows of a source and 16**top sources need."""
    field = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 of the decimal digits, eight shifts a character.
    shift = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, x), range(8)::BIGINT[]), lambda a, b: {shift})"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ord(d)::BIGINT)), lambda c, x: {byte}), 4294967295)"
    parts = [f"leaves AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, {leaf('text')} AS leaf, {leaf(lower)} AS changed, {crc} % 5 = 0 AS hit FROM documents)"]
    parts += ["placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, CASE WHEN hit THEN changed ELSE leaf END AS f0, count(*) OVER (PARTITION BY g) AS n FROM leaves)"]

    def grow(name: str, first: str, count: int) -> None:
        parts.append(f"{name}0 AS ({first})")
        for i in range(count):
            parts.append(f"{name}{i + 1} AS (SELECT g, r // 16 AS r, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h, (n + 15) // 16 AS n FROM {name}{i} GROUP BY g, r // 16, n)")
            side = "coalesce(string_agg(h, '') OVER (PARTITION BY g, r // 16 ORDER BY r ROWS BETWEEN {}), '')"
            left, right = side.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), side.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
            parts.append(f"{name}s{i} AS (SELECT g, r, n > 1 AS up, {left} AS a, {right} AS b FROM {name}{i})")

    grow("t", "SELECT g, r, leaf AS h, n FROM placed", levels)
    parts.append(f"tops AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS r, count(*) OVER () AS n FROM t{levels})")
    grow("u", "SELECT '' AS g, r, subroot AS h, n FROM tops", top)
    parts.append("w0 AS (SELECT doc_id, placed.g, leaf, subroot, placed.r, tops.r AS q, f0 AS f, '' AS p FROM placed JOIN tops ON placed.g = tops.source)")
    steps = [(f"ts{i}", f"s.g = w.g AND s.r = w.r // {16**i}") for i in range(levels)] + [(f"us{i}", f"s.r = w.q // {16**i}") for i in range(top)]
    for k, (table, on) in enumerate(steps):
        moved = "CASE WHEN up THEN sha256(a || f || b) ELSE f END AS f, CASE WHEN up THEN p || a || b ELSE p END AS p"
        parts.append(f"w{k + 1} AS (SELECT doc_id, w.g, leaf, subroot, w.r, q, {moved} FROM w{k} w JOIN {table} s ON {on})")
    shown = f"SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM w{len(steps)}, (SELECT h AS root FROM u{top})"
    return "WITH " + ",\n".join(parts) + "\n" + shown


ORACLES = {
    "op2_secret_scan": f"""
WITH found AS ({_kind_sql("assign", 0, _SQL_NAME + "([A-Za-z0-9+/_.=-]+)", 2, 6)} UNION ALL
{_kind_sql("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL
{_kind_sql("hex", 2, "[0-9a-f]+", 0, 24)}),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(CAST(f.s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(f.s + f.n AS BIGINT) AS VARCHAR), ',' ORDER BY f.s, rank) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id""",
    "op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER w = 1 AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
    "op6_url_filter": r"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    # For pages whose text is their article element, with blocks of p and h1, as in the given tables.
    "op11_html_text": r"""
WITH body AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS body FROM pages),
blocks AS (
  SELECT page_id, url, list_filter(list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda b:
    trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))), lambda b: b <> '') AS blocks FROM body)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text, length(coalesce(array_to_string(blocks, chr(10)), '')) AS n_chars FROM blocks""",
    "op13_manifest": _manifest_sql(),
}
