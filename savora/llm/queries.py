"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from savora.llm import adaptive_rules, collocations, entropy_mix, fast_sketch, html_blocks, mpeg_audio, residual_pack, secret_scan, segment_join, suffix_induced, token_alignment, toxicity, warc
from savora.llm.common import table
from savora.session import materialise, scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALIGNED = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_toxicity(spark, sf_dir):
    """Calibrated toxicity of every document with its nearest labelled examples."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark, sf_dir):
    """Secrets of every document; see `secret_scan.scan`."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    """Pages written as deduplicated WARC records and read back with the salvage reader."""
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    warc.write(pages, path)
    return warc.resolved(warc.read(spark, path), dict(pages.dtypes)["page_id"])


def op4_mpeg_audio(spark, sf_dir):
    """Documents stored as payloads of audio streams, read back from the stored column."""
    return mpeg_audio.read_back(materialise(mpeg_audio.store_texts(table(spark, sf_dir, "documents"))))


def op5_html_blocks(spark, sf_dir):
    """Main text of every page."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_entropy_mix(spark, sf_dir):
    """Copies of every document so that sources meet their targets."""
    mixed = entropy_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op7_adaptive_rules(spark, sf_dir):
    """Counts, measures and the verdict under learned thresholds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = materialise(adaptive_rules.measure(docs).drop("text"))
    limits = adaptive_rules.thresholds(materialise(adaptive_rules.sketches(measured)))
    return adaptive_rules.judge(measured, limits).select("doc_id", *adaptive_rules.COUNTS, "base_failed", "kept")


def op8_residual_pack(spark, sf_dir):
    """Pieces of every document, packed into sequences of 4096 tokens."""
    return residual_pack.pack(residual_pack.pieces(table(spark, sf_dir, "documents"), TOKENIZER))


def op9_fast_sketch(spark, sf_dir):
    """Near-duplicate components over 3-word shingles at 0.85."""
    return fast_sketch.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_induced(spark, sf_dir):
    """Bytes of every document without its repeated 400-byte strings."""
    return suffix_induced.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op11_collocations(spark, sf_dir):
    """The best 2000 phrases of every language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_segment_join(spark, sf_dir):
    """Components of links at 0.9 over 3-word shingles."""
    return segment_join.components(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir):
    """Groups and links of two tokenizations of every document."""
    return token_alignment.align(table(spark, sf_dir, "documents"), *ALIGNED)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_secret_scan, op3_warc, op4_mpeg_audio, op5_html_blocks, op6_entropy_mix, op7_adaptive_rules, op8_residual_pack, op9_fast_sketch, op10_suffix_induced, op11_collocations, op12_segment_join, op13_token_alignment)}
ORACLES: dict[str, str] = {"op11_collocations": """
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
 w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
 g AS (SELECT lang, w[i : i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
 f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 30),
 n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
 cut AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
 s AS (SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score FROM cut c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM s) WHERE o = 1),
 part AS (SELECT lang, g[i : i + m - 1] AS g, f FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE len(g) > m)),
 longer AS (SELECT lang, g, max(f) AS f FROM part GROUP BY 1, 2),
 kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN longer USING (lang, g) WHERE longer.f IS NULL OR 100 * longer.f < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000"""}
