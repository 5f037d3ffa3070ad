"""The queries of this subpackage, each over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from . import exactdup, langid, neardup, packing, pii, quality, segmentation, substring, tokenbin, toxicity
from .runtime import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark, sf_dir):
    return pii.personal_data(documents(spark, sf_dir))


def op2_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir))


def op3_token_ids(spark, sf_dir):
    return tokenbin.round_trip(documents(spark, sf_dir), vocabulary(tokenbin.VOCABULARY))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_exact_duplicates(spark, sf_dir):
    return exactdup.exact_duplicates(documents(spark, sf_dir))


def op6_segmentations(spark, sf_dir):
    return segmentation.sampled_segmentations(documents(spark, sf_dir), vocabulary(segmentation.VOCABULARY)).drop("ids")


def op7_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_substring_dedup(spark, sf_dir):
    return substring.remove_repeats(documents(spark, sf_dir))


def op9_language(spark, sf_dir):
    return langid.languages(documents(spark, sf_dir))


def op10_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), vocabulary(packing.VOCABULARY)).drop("ids")


def reference_spans(spark, sf_dir):
    """The suffix-automaton form of op8: documents without the spans of 13 or more words that `benchmark` holds."""
    return substring.remove_reference_spans(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("kept_text")


QUERIES = {f.__name__: f for f in (op1_pii, op2_near_duplicates, op3_token_ids, op4_toxicity, op5_exact_duplicates, op6_segmentations, op7_quality, op8_substring_dedup, op9_language, op10_packing, reference_spans)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def without(windows: str) -> str:
    """SQL for documents without the words that a row (doc_id, i) of `windows` covers, 13 from word i on."""
    return f"""
        gone AS (SELECT doc_id, list(DISTINCT place) AS places FROM (SELECT doc_id, unnest(range(i, i + 13)) AS place FROM {windows}) GROUP BY doc_id),
        numbered AS (SELECT d.doc_id, d.w, coalesce(g.places, []) AS places FROM d LEFT JOIN gone g USING (doc_id))
        SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(places, i)), ' ')) AS kept_sha256
        FROM numbered"""


ORACLE_SQL = {
    "op2_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]))) END AS s FROM d),
        classes AS (SELECT s, min(doc_id) AS doc FROM sets WHERE len(s) > 0 GROUP BY s),
        shingles AS (SELECT doc, unnest(s) AS g, len(s) AS n FROM classes),
        shared AS (SELECT a.doc AS a, b.doc AS b, a.n AS na, b.n AS nb, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc <> b.doc GROUP BY ALL),
        links AS (SELECT a, b FROM shared WHERE 100 * n >= 75 * (na + nb - n)),
        reach AS (SELECT doc AS node, doc AS root FROM classes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node AND r.root < l.b),
        roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
        SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(r.root, t.doc_id) AS component_id, t.doc_id = coalesce(r.root, t.doc_id) AS kept
        FROM sets t LEFT JOIN classes c ON c.s = t.s LEFT JOIN roots r ON r.node = c.doc
    """,
    "op8_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        windows AS (SELECT doc_id, i, w[i:i + 12] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        firsts AS (SELECT v, min(doc_id) AS first FROM windows GROUP BY v HAVING min(doc_id) < max(doc_id)),
        hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (v) WHERE doc_id > first),
        {without("hits")}
    """,
    "reference_spans": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        r AS (SELECT {WORDS} AS w FROM benchmark),
        known AS (SELECT DISTINCT w[i:i + 12] AS v FROM (SELECT w, unnest(range(1, len(w) - 11)) AS i FROM r)),
        hits AS (SELECT doc_id, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) x WHERE x.w[i:i + 12] IN (SELECT v FROM known)),
        {without("hits")}
    """,
    "op5_exact_duplicates": """
        WITH folded AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        )
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM folded WINDOW same AS (PARTITION BY t)
    """,
}
