"""The operators as queries over the given tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialtrace.session import use_utc, work_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(use_utc(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words are what lies between these characters, in DuckDB's patterns.
WORD = r"[^\x20\x09-\x0D]"


@query(
    "op1_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op1(spark, sf_dir):
    from dialtrace.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op2_token_files")
def op2(spark, sf_dir):
    from dialtrace.llm.token_store import read_tokens, write_tokens

    path = work_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return read_tokens(spark, path)


@query("op3_sentence_pieces")
def op3(spark, sf_dir):
    from dialtrace.llm.sentence_pieces import encode_decode, with_digests

    model = tokenizer_file("piece_bpe_32k.model")
    return with_digests(encode_decode(table(spark, sf_dir, "documents"), model))


def jaccard(width: int) -> str:
    """Shingle sets of ``width`` words, links and components."""
    return rf"""WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}+') AS ws FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i : i + {width - 1}], ' ') for i in range(1, len(ws) - {width - 2})]) END AS sh FROM w
), u AS (SELECT doc_id, len(sh) AS n, md5(unnest(sh)) AS h FROM s
), hits AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM hits WHERE 100 * c >= 80 * (na + nb - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)"""


@query(
    "op4_ngram_join",
    jaccard(5) + """ SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.b) AS component_id
    FROM s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, len(s.sh)""",
)
def op4(spark, sf_dir):
    from dialtrace.llm.ngram_join import near_components

    return near_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_perplexity")
def op5(spark, sf_dir):
    from dialtrace.llm.perplexity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    from dialtrace.llm.suffix_dedup import suffix_dedup

    cleaned = suffix_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query("op7_pseudonyms")
def op7(spark, sf_dir):
    from dialtrace.llm.pseudonyms import pseudonymise, session_key

    return pseudonymise(table(spark, sf_dir, "documents"), session_key(spark)).select("doc_id", "text", "n_pii", "pii_kinds")


@query("op8_packing")
def op8(spark, sf_dir):
    from dialtrace.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


LEDGER = rf"""WITH w AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS ws,
        [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '{WORD}')] AS ls FROM documents
), win AS (
    SELECT doc_id, i, md5(array_to_string(ws[i : i + 7], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), twice AS (
    SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), m AS (
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN covered c USING (doc_id)
), f AS (
    SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 14 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 100 * n_upper > 50 * word_chars THEN 64 ELSE 0 END AS BIGINT) AS failures FROM m
)"""


@query("op9_quality_rules", LEDGER + " SELECT *, failures & 3 <> 0 AS base_failed, failures = 0 AS kept FROM f")
def op9(spark, sf_dir):
    from dialtrace.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


@query(
    "op9b_rule_ablations",
    LEDGER + """ SELECT rule, CAST(count(*) FILTER (failures & bit <> 0) AS BIGINT) AS n_failed,
    CAST(count(*) FILTER (failures = bit) AS BIGINT) AS n_only, CAST(count(*) FILTER (failures & ~bit = 0) AS BIGINT) AS n_kept_without
    FROM f, (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('long_words', 16), ('short_words', 32),
    ('capitals', 64)) AS r(rule, bit) GROUP BY rule""",
)
def op9b(spark, sf_dir):
    from dialtrace.llm.quality_rules import ablations, ledger

    return ablations(ledger(table(spark, sf_dir, "documents")))


@query(
    "op10_line_dedup",
    rf"""WITH p AS (SELECT row_number() OVER () AS page, doc_id, coalesce(source, '') AS host, text FROM documents
    ), l AS (SELECT page, doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM p
    ), k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l
    ), common AS (SELECT host, key FROM k JOIN (SELECT host, count(*) AS total FROM p GROUP BY host) USING (host) WHERE key <> ''
        GROUP BY host, key, total HAVING count(DISTINCT page) >= 5 AND count(DISTINCT page) > 0.01 * total
    ), kept AS (SELECT k.page, k.line, k.no, c.key IS NOT NULL AS dropped FROM k LEFT JOIN common c ON k.host = c.host AND k.key = c.key
    ), r AS (SELECT page, string_agg(line, chr(10) ORDER BY no) FILTER (NOT dropped) AS text, count(*) AS n, count(*) FILTER (dropped) AS d FROM kept GROUP BY page
    ) SELECT doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, CAST(coalesce(r.n, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(r.d, 0) AS BIGINT) AS n_dropped FROM p LEFT JOIN r USING (page)""",
)
def op10(spark, sf_dir):
    from dialtrace.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query(
    "op11_hyper_minhash",
    jaccard(4) + """ SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
    FROM s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, len(s.sh)""",
)
def op11(spark, sf_dir):
    from dialtrace.llm.hyper_minhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


@query(
    "op12_filter_audit",
    rf"""WITH RECURSIVE orders AS (SELECT '' AS filter_order UNION ALL
        SELECT filter_order || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(filter_order, f)
    ), steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, left(filter_order, step - 1) AS ahead
        FROM orders, range(1, 6) r(step) WHERE len(filter_order) = 5
    ), w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS ws FROM documents
    ), marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
    ), m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
            || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
        FROM w LEFT JOIN marks USING (doc_id)
    ), c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails
    ), a AS (SELECT part, filter_order, step, f, c.*, translate(fails, ahead, '') = fails AS here, contains(fails, f) AS failed FROM steps, c
    ), t AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (here AND NOT failed), 0) AS BIGINT) AS kept,
            CAST(coalesce(sum(n) FILTER (here AND failed), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (NOT here AND failed), 0) AS BIGINT) AS redundant,
            CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (here AND failed), 0) AS BIGINT) AS good_lost,
            CAST(coalesce(sum(toxic) FILTER (here AND failed), 0) AS BIGINT) AS toxic_lost FROM a GROUP BY part, filter_order, step, f
    ) SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM t""",
)
def op12(spark, sf_dir):
    from dialtrace.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def hashed(*fields: str) -> str:
    """SQL of a leaf's digest."""
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')" for x in fields) + ")"


CHECKSUM = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, n: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END)))"""


@query(
    "op13_merkle_manifest",
    f"""WITH RECURSIVE l AS (SELECT doc_id, lang, {hashed("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
        {hashed("doc_id", "source", "lang", "(n_chars + 1)", "text")} AS other, coalesce({CHECKSUM} % 7 = 0, false) AS hit FROM documents
    ), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS pos FROM l
    ), low AS (SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS h FROM p GROUP BY lang UNION ALL
        SELECT lang, level + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], ''))) FROM low WHERE len(h) > 1
    ), tops AS (SELECT lang, h[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE len(h) = 1
    ), high AS (SELECT 0 AS level, list(subroot ORDER BY place) AS h FROM tops UNION ALL
        SELECT level + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], ''))) FROM high WHERE len(h) > 1
    ), steps AS (SELECT p.lang, p.pos, level, (p.pos >> level) & 1 AS slot, h[xor(p.pos >> level, 1) + 1] AS sibling
            FROM p JOIN low ON p.lang IS NOT DISTINCT FROM low.lang WHERE len(h) > 1 UNION ALL
        SELECT p.lang, p.pos, t.height + level, (t.place >> level) & 1, h[xor(t.place >> level, 1) + 1] FROM p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang, high WHERE len(h) > 1
    ), paths AS (SELECT lang, pos, list({{'slot': slot, 'sibling': sibling}} ORDER BY level) AS path FROM steps GROUP BY lang, pos
    ), fold AS (SELECT lang, pos, 1 AS i, CASE WHEN hit THEN other ELSE leaf END AS node FROM p UNION ALL
        SELECT f.lang, f.pos, i + 1, sha256(CASE WHEN path[i].sibling IS NULL THEN node WHEN path[i].slot = 0 THEN node || path[i].sibling ELSE path[i].sibling || node END)
        FROM fold f JOIN paths s ON f.lang IS NOT DISTINCT FROM s.lang AND f.pos = s.pos WHERE i <= len(path)
    ), folded AS (SELECT lang, pos, arg_max(node, i) AS folded_root FROM fold GROUP BY lang, pos
    ) SELECT doc_id, leaf, subroot, (SELECT h[1] FROM high WHERE len(h) = 1) AS root,
        sha256(coalesce(array_to_string(list_transform(list_filter(path, lambda x: x.sibling IS NOT NULL), lambda x: x.sibling), ''), '')) AS proof_sha256,
        folded_root, folded_root = (SELECT h[1] FROM high WHERE len(h) = 1) AS verified
    FROM p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang JOIN folded f ON p.lang IS NOT DISTINCT FROM f.lang AND p.pos = f.pos
    LEFT JOIN paths s ON p.lang IS NOT DISTINCT FROM s.lang AND p.pos = s.pos""",
)
def op13(spark, sf_dir):
    from dialtrace.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
