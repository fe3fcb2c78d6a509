"""The registered queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm.words import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (session, table folder)."""

    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            bounded_batches(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op7_compression_bands")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.quality import judge

    judged = judge(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "document_ratio", "least_chunk_ratio", "most_chunk_ratio",
    )


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents),
keyed AS (
  SELECT doc_id, line, place,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, line, place, keeper IS NOT NULL AND keeper <> doc_id AS gone
  FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op10_line_dedup", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.lines import drop_repeated_lines

    done = drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_mix_sources")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.mixing import draws

    drawn = draws(table(spark, folder, "documents").select("doc_id", "source", "text"), with_text=False)
    return drawn.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "shards"
    )


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.packing import pack

    return pack(table(spark, folder, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i
  FROM windows JOIN least USING (h) WHERE d < doc_id),
placed AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM words),
judged AS (
  SELECT p.doc_id, p.x, p.i, g.i IS NOT NULL AS removed
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i),
found AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN removed THEN 1 ELSE 0 END) AS r,
         string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS kept
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN found USING (doc_id)
"""


@query("op4_repeated_passages", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.repeats import drop_repeats

    done = drop_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_scaled_sketch")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.sketch import NEW, compare

    return compare(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", *NEW)


@query("op6_subword_lattice")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.lattice import score

    return score(table(spark, folder, "documents").select("doc_id", "text"))


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.toxicity import apply, fit

    documents = table(spark, folder, "documents").select("doc_id", "text")
    return apply(documents, fit(documents, table(spark, folder, "labels")))


OP1_SQL = """
WITH held AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM held),
least AS (SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM sized LEFT JOIN least USING (payload_digest)
"""


@query("op1_arc_to_warc", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.archives import convert_pages

    done = convert_pages(table(spark, folder, "pages"))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = r"""
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(action, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
addresses AS (SELECT DISTINCT host, path FROM cut),
ruled AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(action, length(rule_host || rule_path)) AS action
  FROM addresses JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path),
known AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1 OR (quality = 1 AND toxic = 0)) GROUP BY doc_id),
hosts AS (
  SELECT host, count(bad) FILTER (host <> '') AS n, coalesce(sum(bad) FILTER (host <> ''), 0) AS bad,
         regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', ''), '[.]+$', '') AS bare
  FROM (SELECT DISTINCT page_id, host FROM cut) LEFT JOIN known USING (page_id) GROUP BY host),
named AS (
  SELECT host, n, bad,
         CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN bare
              ELSE array_to_string(string_split(bare, '.')[-2:], '.') END AS domain,
         CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN bare ELSE string_split(bare, '.')[-1] END AS suffix
  FROM hosts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
children AS (
  SELECT 1 AS level, '' AS parent, n, bad FROM suffixes WHERE n > 0
  UNION ALL SELECT 2, suffix, n, bad FROM domains WHERE n > 0
  UNION ALL SELECT 3, domain, n, bad FROM named WHERE n > 0),
groups AS (
  SELECT level, parent, sum(n)::DOUBLE AS pages, count(*) AS k, sum(n * n) AS squares,
         sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS between_, sum(bad - bad * bad / n) AS within_
  FROM children GROUP BY ALL),
moments AS (
  SELECT level, sum(k - 1) AS free, sum(pages - k) AS rest, sum(between_) / nullif(sum(k - 1), 0) AS msb,
         sum(within_) / nullif(sum(pages - k), 0) AS msw, sum(pages - squares / pages) / nullif(sum(k - 1), 0) AS n0
  FROM groups GROUP BY level),
weights AS (
  SELECT l.level, least(greatest(CASE WHEN free > 0 AND rest > 0 THEN CASE WHEN msb > msw THEN msw / ((msb - msw) / n0)
                                                                           ELSE 1000.0 END ELSE 2.0 END, 2.0), 1000.0) AS w
  FROM (VALUES (1), (2), (3)) AS l(level) LEFT JOIN moments USING (level)),
root AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS mean FROM suffixes),
suffix_means AS (SELECT suffix, (w * mean + bad) / (w + n) AS mean FROM suffixes, root, weights WHERE level = 1),
domain_means AS (
  SELECT domain, (w * mean + bad) / (w + n) AS mean FROM domains JOIN suffix_means USING (suffix), weights WHERE level = 2),
judged AS (
  SELECT host, (w * mean + bad) / (w + n) AS mean, w + n AS weight
  FROM named JOIN domain_means USING (domain), weights WHERE level = 3),
verdicts AS (
  SELECT host, mean - 1.2816 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.3 AS blocked FROM judged)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM cut JOIN verdicts USING (host) LEFT JOIN ruled USING (host, path)
"""


@query("op13_host_reputation", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.reputation import ALLOW, BLOCK, Rule, judge_urls

    rules = [
        Rule(ALLOW, "com"), Rule(BLOCK, "example.com", "/en/"), Rule(ALLOW, "www.example.com", "/en/"),
        Rule(BLOCK, "net", "/es/"), Rule(BLOCK, "net", "/fr/"),
    ]
    # the given labels stand in for outcomes of pages: a page is bad if the label of its number is
    outcomes = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    judged = judge_urls(table(spark, folder, "pages").select("page_id", "url"), outcomes, rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _told_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(_told_sql(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


_CRC_SQL = """xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]),
                                  lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _tree_sql(name: str, start: str) -> str:
    """CTE of all nodes of the trees that stand on ``start(tree, pos, size, digest)``."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, size, digest FROM {start}
  UNION ALL
  SELECT tree, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE size > 1 GROUP BY tree, level, pos // 2, size)"""


OP11_SQL = f"""
WITH RECURSIVE
told AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, {_CRC_SQL} % 7 = 0 AS touched, {_leaf_sql('n_chars + 1')} AS changed,
  FROM documents),
leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN touched THEN changed ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS size
  FROM told),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
placed AS (
  SELECT l.*, tree FROM leaves l JOIN langs ON l.lang IS NOT DISTINCT FROM langs.lang),
bottom AS (SELECT tree, pos, size, leaf AS digest FROM placed),
{_tree_sql('nodes', 'bottom')},
subroots AS (SELECT tree, digest FROM nodes WHERE size = 1),
tops AS (SELECT 0 AS tree, tree AS pos, (SELECT count(*) FROM langs) AS size, digest FROM subroots),
{_tree_sql('upper_', 'tops')},
steps AS (
  SELECT p.tree, p.pos, n.level, n.digest AS sibling, (p.pos >> n.level) & 1 AS is_right
  FROM placed p JOIN nodes n ON n.tree = p.tree AND n.pos = xor(p.pos >> n.level, 1)
  UNION ALL
  SELECT p.tree, p.pos, 100 + u.level, u.digest, (p.tree >> u.level) & 1
  FROM placed p JOIN upper_ u ON u.pos = xor(p.tree >> u.level, 1)),
ways AS (SELECT tree, pos, string_agg(sibling, '' ORDER BY level) AS path FROM steps GROUP BY ALL),
heights AS (
  SELECT tree, CAST(ceil(log2(count(*))) AS BIGINT) AS low FROM placed GROUP BY tree),
folded AS (
  SELECT tree, pos, 0 AS level, low, shown AS digest FROM placed JOIN heights USING (tree)
  UNION ALL
  SELECT f.tree, f.pos, CASE WHEN f.level + 1 = low THEN 100 ELSE f.level + 1 END, low,
         sha256(CASE WHEN sibling IS NULL THEN f.digest WHEN is_right = 1 THEN sibling || f.digest ELSE f.digest || sibling END)
  FROM (SELECT tree, pos, CASE WHEN level = 0 AND low = 0 THEN 100 ELSE level END AS level, low, digest FROM folded) f
  LEFT JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level
  WHERE f.level < 100 + (SELECT ceil(log2(count(*))) FROM langs)),
ends AS (SELECT tree, pos, arg_max(digest, level) AS folded_root FROM folded GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.digest AS subroot, (SELECT digest FROM upper_ WHERE size = 1) AS root,
       sha256(coalesce(path, '')) AS proof_sha256, folded_root,
       folded_root = (SELECT digest FROM upper_ WHERE size = 1) AS verified
FROM placed p JOIN subroots s USING (tree) JOIN ends USING (tree, pos) LEFT JOIN ways USING (tree, pos)
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.merkle import commit, leaf_of, proofs

    documents = table(spark, folder, "documents")
    changed = leaf_of("doc_id", "source", "lang", F.col("n_chars") + 1, "text")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    manifest = commit(
        documents, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", F.when(touched, changed)
    )
    found = proofs(manifest).withColumnRenamed("key", "doc_id")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS sizes(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, a FROM f WHERE m > 1 AND a >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM candidates)),
measured AS (
  SELECT c.lang, c.phrase, c.a, fx.a AS l, fy.a AS r,
         CAST((1000000::HUGEINT * c.a * c.a) // (fx.a::HUGEINT * fy.a) AS BIGINT) AS score, k
  FROM cuts c JOIN f fx ON fx.lang = c.lang AND fx.phrase = x JOIN f fy ON fy.lang = c.lang AND fy.phrase = y
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, sub, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS sub
        FROM (SELECT *, string_split(phrase, ' ') AS w FROM candidates WHERE m = 3))
  GROUP BY ALL),
kept AS (
  SELECT d.* FROM measured d LEFT JOIN around s ON s.lang = d.lang AND s.sub = d.phrase
  WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from textguard.llm.collocations import collocations

    return collocations(table(spark, folder, "documents").select("lang", "text"))
