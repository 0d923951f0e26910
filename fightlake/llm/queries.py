"""The training-data queries, one for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, hard_negatives, line_dedup, ordinal, packing, pii, rans, repetition, secret_scan, simhash, spelling, warc
from .common import shared_dir, table, written


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    stretches, _ = written(chat.format_chats(turns), "chats")
    return chat.digests(stretches).drop("n_tokens", "loss_tokens")


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit(ordinal.bounded_sample(docs, ordinal.grade_of(table(spark, sf_dir, "labels"))))
    return ordinal.score(docs, model)


def op6_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.read_ids(rans.write_ids(table(spark, sf_dir, "documents"), shared_dir(spark, "token-ids")), with_ids=False)


def op7_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages")), shared_dir(spark, "warc"))
    found = warc.read_records(warc.normalise(archives, shared_dir(spark, "warc-members")), with_html=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = ("assign", "access", "hex")
    counts = [F.size(secret_scan.of_kinds("spans", k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined("spans", *base), 256).alias("base_sha256"), secret_scan.joined("spans", *secret_scan.KINDS).alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_feistel_pseudonyms": op4_feistel_pseudonyms,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_rans_token_ids": op6_rans_token_ids,
    "op7_warc_normaliser": op7_warc_normaliser,
    "op8_certified_packing": op8_certified_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {}

_DUP = ", ".join(f"count(*) over (partition by d.doc_id, d.w[i:i+{n - 1}]) c{n}, row_number() over (partition by d.doc_id, d.w[i:i+{n - 1}] order by i) r{n}" for n in repetition.NGRAM_PERCENT)
_COVER = ", ".join(f"max(case when i <= n - {n - 1} and r{n} > 1 then 1 else 0 end) over (partition by doc_id order by i rows between {n - 1} preceding and current row) x{n}" for n in repetition.NGRAM_PERCENT)
ORACLE_SQL["op9_quality_rules"] = f"""
with d as (select doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
p as (select d.doc_id, len(w) n, i, length(w[i]) sz, {_DUP} from d, unnest(range(1, len(w) + 1)) u(i)),
q as (select *, max(case when i <= n - 7 and c8 > 1 then 1 else 0 end) over (partition by doc_id order by i rows between 7 preceding and current row) b, {_COVER} from p),
g as (select doc_id, sum(sz) word_chars, sum(b) n_repeat_words, {", ".join(f"sum(sz * x{n}) dup{n}_chars" for n in repetition.NGRAM_PERCENT)} from q group by 1),
l as (select doc_id, i, x, row_number() over (partition by doc_id, x order by i) r from (select doc_id, generate_subscripts(string_split(t, chr(10)), 1) i, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
m as (select doc_id, sum(case when r > 1 then 1 else 0 end) n_dup_lines, sum(length(x)) line_chars, sum(case when r > 1 then length(x) else 0 end) dup_line_chars from l group by 1),
a as (select d.doc_id, len(w)::bigint n_words, coalesce(word_chars, 0)::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words, coalesce(line_chars, 0)::bigint line_chars, coalesce(dup_line_chars, 0)::bigint dup_line_chars,
  {", ".join(f"coalesce(dup{n}_chars, 0)::bigint dup{n}_chars" for n in repetition.NGRAM_PERCENT)}
  from d left join g using (doc_id) left join m using (doc_id)),
v as (select *, n_words < {repetition.MIN_WORDS} or 100 * n_repeat_words > {repetition.BASE_PERCENT} * n_words base_failed from a)
select *, not base_failed and 100 * dup_line_chars <= {repetition.LINE_CHARS_PERCENT} * line_chars and {" and ".join(f"100 * dup{n}_chars <= {p} * word_chars" for n, p in repetition.NGRAM_PERCENT.items())} kept from v"""

ORACLE_SQL["op10_line_dedup"] = f"""
with l as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i, unnest(string_split(coalesce(text, ''), chr(10))) x from documents),
k as (select *, translate(trim(x, {_WS}), '{line_dedup.UPPER}', '{line_dedup.LOWER}') key from l),
f as (select *, length(key) >= {line_dedup.MIN_CHARS} and doc_id > min(doc_id) over (partition by key) gone from k)
select doc_id, count(*) n_lines, sum(gone::int)::bigint n_dropped, sha256(coalesce(string_agg(x, chr(10) order by i) filter (not gone), '')) kept_sha256 from f group by 1"""


_SAID = "chr(92) || '### Assistant: </turn> ok'"


def _guarded(x: str, *controls: str) -> str:
    for c in ("chr(92)", *controls):
        x = f"replace({x}, {c}, chr(92) || {c})"
    return x


ORACLE_SQL["op3_chat_format"] = f"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations union all select -7, 0, 'user', {_SAID} union all select -7, 1, 'assistant', {_SAID}),
s as (select *, row_number() over (partition by conv_id order by turn nulls first, r, t) i from c)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by i)) turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(t, '' order by i) filter (r = 'assistant'), '')) loss_sha256,
  sum({len(chat.OPEN) + len(chat.COLON) + len(chat.CLOSE)} + length({_guarded("r", "'###'", "'</turn>'", "':'")}) + length({_guarded("t", "'###'", "'</turn>'")}))::bigint formatted_chars
from s group by 1"""

ORACLE_SQL["op7_warc_normaliser"] = f"""
with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
b as (select *, max(page_id) over (partition by payload_digest) best from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= {warc.MIN_REVISIT} and page_id < best then 'revisit' else 'response' end record_type,
  case when payload_bytes >= {warc.MIN_REVISIT} and page_id < best then best end refers_to from b"""

ORACLE_SQL["op12_hard_negatives"] = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id aid, b.vec_id bid, a.l = b.l same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint score
  from r a, r b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select *, row_number() over (partition by aid order by score desc, bid) place from s where same qualify place <= 5),
n as (
  select p.aid, p.bid pid, p.score ps, s.bid nid, s.score ns, row_number() over (partition by p.aid, p.bid order by s.score desc, s.bid) k
  from p join s on s.aid = p.aid and not s.same where 80 * p.score <= 100 * s.score and s.score <= p.score qualify k <= 5)
select aid anchor_id, pid positive_id, k::int rank, nid negative_id, ps positive_score, ns negative_score from n"""

# CRC-32 a byte at a time; letters up to U+00FF have at most two bytes.
ORACLE_SQL["op13_spelling_variants"] = f"""
with recursive
t as (
  select list(list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, b) order by b) tab
  from (select unnest(range(256)) b)),
r as (
  select doc_id, run, count(*) c
  from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{line_dedup.UPPER}', '{line_dedup.LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) run from documents)
  where length(run) >= 6 group by all),
b as (
  select *, flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''), lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [195, ord(x)::bigint - 64] end)) bytes
  from r),
h as (select run, c, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) h from b, t),
w as (select case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end word, sum(c)::bigint n from h group by 1 having length(word) >= 6 and n >= 5),
k as (select word, n, i, word[:i - 1] || word[i + 1:] cut from (select *, unnest(range(1, length(word) + 1)) i from w)),
p as (
  select a.word, b.word near, b.n near_n from k a join k b on a.i = b.i and a.cut = b.cut and a.word <> b.word and length(a.word) = length(b.word)
  union select a.word, b.word, b.n from k a join w b on a.cut = b.word
  union select b.word, a.word, a.n from k a join w b on a.cut = b.word),
f as (select word, count(*) n_near, min(struct_pack(less := -near_n, near := near)) best from p group by 1),
v as (select w.word, n, coalesce(n_near, 0) n_near, case when -best.less >= 5 * n then best.near end form, case when -best.less >= 5 * n then -best.less end form_n from w left join f using (word)),
g as (select word, word last_word, form from v union all select g.word, g.form, v.form from g join v on v.word = g.form)
select v.word, v.form, g.last_word root, n, n_near, form_n from v join g on g.word = v.word and g.form is null"""
