"""Registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serploom.llm import chat, chunked_bpe, decontam, licenses, lm_scores, mixing, neardup, periodic_runs, quality, ranked_search, secret_scan, token_counts, wrappers
from serploom.llm.common import LOWER, UPPER

#: folder with the files of public tokenizers
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _joined_digest(items) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = licenses.with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), out="l")
    return docs.select("doc_id", *[f"l.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    shown = chat.format_conversations(rows.unionByName(extra), f"{TOKENIZERS}/byte_bpe_50k.json")
    read = shown.select("conv_id", chat.digests(shown).alias("d")).select("conv_id", "d.*")
    return read.select("conv_id", F.col("n_read").alias("n_turns"), "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", secret_scan.secret_spans(F.col("text")).alias("s"))
    base = F.filter("s", lambda x: x.kind != "named")
    label = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))
    count = lambda k: F.size(F.filter("s", lambda x: x.kind == k)).cast("bigint").alias(f"n_{k}")
    return docs.select(
        "doc_id", *map(count, secret_scan.KINDS), _joined_digest(F.transform(base, label)).alias("base_sha256"),
        F.array_join(F.transform("s", label), ",").alias("spans"),
    )


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores.with_lm_scores(docs, good).select("doc_id", "lm.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontam.with_contamination(docs, table(spark, sf_dir, "benchmark"), out="c").select("doc_id", "c.*")
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        _joined_digest(F.array_sort(F.col("items").cast("array<string>"))).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = wrappers.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), out="q").select("doc_id", "q.*")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.vocabulary_of(f"{TOKENIZERS}/piece_bpe_32k.model")
    return token_counts.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "n_tokens")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    encoded = chunked_bpe.with_token_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return encoded.select("doc_id", chunked_bpe.digests(F.col("token_ids"), path).alias("d")).select("doc_id", "d.*")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.with_runs(docs, out="r", plant=F.when(h % 10 == 0, F.floor(h / 10))).select("doc_id", "r.*")
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    best = found.withColumn("best", periodic_runs.longest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_mix_sources": op3_mix_sources,
    "op4_chat_format": op4_chat_format,
    "op5_secret_scan": op5_secret_scan,
    "op6_lm_scores": op6_lm_scores,
    "op7_decontamination": op7_decontamination,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_search": op11_ranked_search,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_periodic_runs": op13_periodic_runs,
}

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"



def _license_sql() -> str:
    """Templates as rows: template, label, base, word, place, key (it belongs to a key phrase)."""
    rows = []
    for t, x in enumerate(licenses.TEMPLATES):
        keys = {i for start, n in x.keys for i in range(start, start + n)}
        rows += [f"({t}, '{x.label}', {x.base}, '{w}', {j}, {j in keys})" for j, w in enumerate(x.words)]
    return f"""
with tm(t, label, base, word, j, key) as (values {", ".join(rows)}),
sizes as (select t, label, base, count(*) as n, count(*) filter (where key) as n_key from tm group by all),
dw as (select doc_id, {_WORDS} as w from documents),
pos as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as i from dw),
hits as (select doc_id, t, i - j as place, j, key from pos join tm using (word)),
places as (select doc_id, t, place from hits join sizes using (t) where key group by doc_id, t, place, n_key having count(*) = n_key),
scores as (select h.doc_id, h.t, count(distinct h.j) as met from hits h join places p on h.doc_id = p.doc_id and h.t = p.t and h.place = p.place group by all),
labelled as (
  select s.doc_id, string_agg(distinct label, ',' order by label) as labels, string_agg(distinct label, ',' order by label) filter (where base) as base_labels,
         max(met / n) as score
  from scores s join sizes using (t) group by s.doc_id),
based as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word from places join sizes using (t) where base group by doc_id)
select dw.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
       coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from dw left join labelled using (doc_id) left join based using (doc_id)
"""


_ESCAPE = r"regexp_replace(coalesce({}, ''), '<(\\*)\|', '<\\\1|', 'g')"

ORACLE = {
    "op4_chat_format": f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
said as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
         sum(length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")}) + {len(chat.START + chat.SEP + chat.END)}) as formatted_chars
  from rows group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       cast(formatted_chars as bigint) as formatted_chars
from said
""",
    "op1_license_scan": _license_sql(),
    "op11_ranked_search": f"""
with docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
counted as (select r, doc_id, len(w) as n, w from docs where len(w) > 0),
totals as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from counted),
asked as (select item_id, term, count(*) as c from (select item_id, unnest({_WORDS}) as term from benchmark) group by all),
tfs as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, n, unnest(w) as term from counted) where term in (select term from asked) group by all),
dfs as (select term, count(*) as df from tfs group by term),
weights as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w from dfs, totals),
impacts as (
  select r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms))) as impact
  from tfs, totals),
scores as (
  select item_id, r, doc_id, cast(sum(c * w * impact) as bigint) as score
  from asked join weights using (term) join impacts using (term) group by item_id, r, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
where rank <= 20
""",
    "op7_decontamination": f"""
with dw as (select doc_id, {_WORDS} as w from documents),
iw as (select item_id, {_WORDS} as w from benchmark),
patterns as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as p
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0)),
sizes as (select distinct k from patterns),
starts as (select doc_id, k, w, unnest(range(1, len(w) - k + 2)) as i from dw, sizes where len(w) >= k),
hits as (select s.doc_id, s.i, s.k, p.item_id from starts s join patterns p on s.k = p.k and array_to_string(s.w[s.i : s.i + s.k - 1], ' ') = p.p),
words as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + k)) as x from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
          from (select distinct doc_id, item_id from hits) group by doc_id)
select dw.doc_id, len(dw.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
""",
}
