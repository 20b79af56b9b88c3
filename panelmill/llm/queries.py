"""The queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocation, exact_dedup, html_text, jaccard, language, minhash, packing, quality, token_counts, toxicity, whitening
from .common import crc_bucket, read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE, public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"), WORD_BPE, 2048)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE, public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), crc_bucket("doc_id", 5) != 0)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    case = spark.sql("select -7L conv_id, t.turn, t.role, '' text from values (0L, 'user'), (1L, 'assistant') t(turn, role)").withColumn("text", F.lit(said))
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(case)
    done = chat.format_conversations(rows)
    loss = chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    turns = F.array_join(F.transform("recovered", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.withColumn("_loss", loss).select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents", "doc_id", "text"), n_words=4, percent=85)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    counts = language.train(docs, crc_bucket("doc_id", 4) != 2)
    scored = language.identify(docs.select("doc_id", "text"), counts)
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), n_words=3, percent=85)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(read(spark, sf_dir, "documents", "text", "lang"), max_words=3, least=10, top=2000, part=50)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), components=4, scale=256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP6_SQL = r"""
with a as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
       doc_id = min(doc_id) over (partition by t) kept, sha256(t) text_sha256 from a"""

OP7_SQL = r"""
with said as (select -7::bigint conv_id, unnest([0, 1])::bigint turn, unnest(['user', 'assistant']) "role", '\### Assistant: </turn> ok' text),
a as (select conv_id, turn, coalesce("role", '') r, coalesce(text, '') t from conversations union all select * from said),
b as (select *, contains(t, '</turn>' || chr(10)) or regexp_matches(t, '(?s)\\.') or contains(t, '### ') or contains(r, ': ')
             or contains(r, '</turn>' || chr(10)) or regexp_matches(r, '(?s)\\.') clash from a),
c as (select *, case when clash then replace(replace(replace(t, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') else t end et,
             case when clash then replace(replace(replace(replace(r, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ': ', ':\ ') else r end er from b)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) turns_sha256,
       coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (r = 'assistant'), '')) loss_sha256,
       sum(4 + length(er) + 2 + length(et) + 8)::bigint formatted_chars from c group by 1"""

OP8_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id z, count(*) i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, z from p join n nx on nx.doc_id = x join n nz on nz.doc_id = z where 100 * i >= 85 * (nx.n + nz.n - i)),
e as (select x a, z b from l union all select z, x from l),
r as (select doc_id a, doc_id c from documents union select e.b, r.c from r join e on e.a = r.a)
select w.doc_id, coalesce(n.n, 0) n_shingles, min(r.c) component_id from w left join n using (doc_id) join r on r.a = w.doc_id group by 1, 2"""


OP11_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id z, count(*) i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, z from p join n nx on nx.doc_id = x join n nz on nz.doc_id = z where 100 * i >= 85 * (nx.n + nz.n - i)),
e as (select x a, z b from l union all select z, x from l),
r as (select doc_id a, doc_id c from documents union select e.b, r.c from r join e on e.a = r.a)
select w.doc_id, coalesce(n.n, 0) n_shingles, min(r.c) component_id, w.doc_id = min(r.c) kept from w left join n using (doc_id) join r on r.a = w.doc_id group by 1, 2"""

OP12_SQL = r"""
with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
g as (select lang, 1 k, unnest(w) phrase from w
      union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
      union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w),
f as (select lang, k, phrase, count(*) a from g group by all),
n as (select lang, sum(a)::bigint n from f where k = 1 group by 1),
c as (select * from f where k > 1 and a >= 10),
longer as (select lang, phrase, max(a) longest from (
      select lang, a, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) phrase from c where k = 3
      union all select lang, a, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) from c where k = 3) group by 1, 2),
kept as (select c.* from c left join longer using (lang, phrase) where longest is null or 100 * longest < 50 * c.a),
cuts as (select lang, phrase, a, 1 cut, split_part(phrase, ' ', 1) lp, substr(phrase, length(split_part(phrase, ' ', 1)) + 2) rp from kept
      union all select lang, phrase, a, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) from kept where k = 3),
scored as (select cuts.*, lf.a l, rf.a r, 1000000::hugeint * cuts.a * cuts.a // (lf.a::hugeint * rf.a) score from cuts
      join f lf on lf.lang = cuts.lang and lf.phrase = lp join f rf on rf.lang = cuts.lang and rf.phrase = rp),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, n, score::bigint score
from best join n using (lang) qualify "rank" <= 2000"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can say: the others are compared with plain Python in tests/llm."""
    return {"op6_exact_dedup": OP6_SQL, "op7_chat_format": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op11_minhash": OP11_SQL, "op12_collocations": OP12_SQL}
