"""The thirteen operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontam, exact, langid, mixing, pagetext, pii, repair, simhash, suffix, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of `documents`: three-word shingles, two bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of `documents`, learnt from `labels`."""
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of `documents`."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all `pages`, written and read back."""
    path = warc.new_path(spark)
    warc.write(_table(spark, sf_dir, "pages"), path, least_bytes=0)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical exact digests of all `documents` and of their edited texts."""
    return exact.fingerprints(_table(spark, sf_dir, "documents"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier one of `documents` has, removed."""
    return suffix.deduplicate(_table(spark, sf_dir, "documents"), least=50)


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap: documents not listed are clean."""
    found = decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "place", "compared", "agree")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatting of all `conversations` and conversation -1, read back from the output."""
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    done = chat.format_conversations(own.unionByName(extra))
    back = chat.read_conversations(done)
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of `documents`."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.select(
        "doc_id",
        *[F.size(F.col("base")[k]).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(pii.all_spans(F.col("base"), none)), 256).alias("base_sha256"),
        pii.listed(pii.all_spans(F.col("base"), F.col("extra"))).alias("spans"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all `documents`, sources weighing 1, 2, 3 in turn."""
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    shards = F.array_join(F.sort_array(F.transform("draws", lambda d: d["shard"])), ",")
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", F.size("draws").cast("long").alias("n_draws"), shards.alias("shards"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and three words of `documents`, the first 2000 of each language."""
    return collocations.mine(_table(spark, sf_dir, "documents"), longest=3, least=10, cover=50, top=2000)


def op12_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every one of `pages`."""
    found = pagetext.main_texts(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all `conversations` after damage."""
    return repair.audits(repair.damage(_table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_langid": op2_langid,
    "op3_warc": op3_warc,
    "op4_fingerprints": op4_fingerprints,
    "op5_suffix": op5_suffix,
    "op6_decontam": op6_decontam,
    "op7_chat": op7_chat,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_collocations": op11_collocations,
    "op12_pagetext": op12_pagetext,
    "op13_repair": op13_repair,
}

#: Rows of op7: the turns as they are, and the length that the template gives them.
OP7_SQL = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
  lag(role) over (partition by conv_id order by turn nulls first, role, text) as before from c),
e as (select *, before is null or before <> role as opens,
  length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) as text_chars,
  length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) as role_chars from o)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by n), '')) as loss_sha256,
  cast(sum(text_chars + 6 + case when opens then role_chars + 9 + 11 else 0 end) as bigint) as formatted_chars
from e group by conv_id"""

#: Rows of op3: each five digits of the hexadecimal SHA-1 are four in base 32.
OP3_SQL = """
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as first from pages)
select page_id, cast(strlen(t) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, cast((k // 4) * 5 + 1 as int), 5))::bigint >> cast(15 - 5 * (k % 4) as int)) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, true as whole
from p"""

#: Rows of op5: all strings of 50 bytes with the smallest document each starts in, and the runs that a larger one loses.
OP5_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as x from documents),
w as (select doc_id, unnest(range(1, greatest(octet_length(x) - 48, 1))) as i, x from d),
h as (select doc_id, i, hash(x[i:i + 49]) as h from w),
o as (select h, min(doc_id) as owner from h group by h),
l as (select doc_id, i from h join o using (h) where owner < doc_id),
s as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 50, true) as opens from l),
g as (select doc_id, i, sum(opens::int) over (partition by doc_id order by i) as k from s),
r as (select doc_id, k, min(i) as a, max(i) + 49 as b from g group by doc_id, k),
f as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as before from r),
p as (select f.doc_id, a, x[before + 1:a - 1] as part from f join d using (doc_id) union all
  select d.doc_id, 9223372036854775807, x[coalesce(m.b, 0) + 1:octet_length(x)] from d left join (select doc_id, max(b) as b from r group by doc_id) m using (doc_id)),
k as (select doc_id, sha256(unhex(string_agg(hex(part), '' order by a))) as kept_sha256 from p group by doc_id),
n as (select doc_id, sum(b - a + 1) as n_removed, count(*) as n_spans from r group by doc_id)
select d.doc_id, cast(octet_length(x) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, kept_sha256 from d join k using (doc_id) left join n using (doc_id)"""

#: Rows of op6 by all alignments of which enough words agree, without seeds: of the best runs of words the first.
OP6_SQL = """
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from documents),
b as (select distinct item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from benchmark where item_id is not null),
i as (select item_id, len(w) as n, least(15, len(w)) as c, w from b),
dw as (select doc_id, len(w) as len, unnest(range(len(w))) as p, unnest(w) as word from d),
iw as (select item_id, n, c, unnest(range(n)) as q, unnest(w) as word from i),
m as (select doc_id, item_id, p - q as shift, any_value(n) as n, any_value(c) as c, any_value(len) as len, list(q) as qs from dw join iw using (word) group by doc_id, item_id, p - q having count(*) >= ceil(0.8 * any_value(c) - 1e-9)),
s as (select *, unnest(range(greatest(0, -shift), least(n, len - shift) - c + 1)) as b0 from m),
a as (select doc_id, item_id, b0 + shift as place, c as compared, len(list_filter(qs, lambda x: x >= b0 and x < b0 + c)) as agree from s),
r as (select *, row_number() over (partition by doc_id, item_id order by agree desc, place) as k from a where agree >= ceil(0.8 * compared - 1e-9))
select doc_id, item_id, cast(place as bigint) as place, cast(compared as bigint) as compared, cast(agree as bigint) as agree from r where k = 1"""

#: Rows of op11 by counting all phrases.
OP11_SQL = """
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
g as (select lang, k, unnest(list_transform(range(len(ws) - k + 1), lambda i: array_to_string(ws[i + 1:i + k], ' '))) as phrase from w, (select unnest(range(1, 4)) as k) where len(ws) >= k),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 10),
v as (select lang, array_to_string(ws[1:2], ' ') as phrase, a from c where k = 3 union all select lang, array_to_string(ws[2:3], ' '), a from c where k = 3),
d as (select c.* from c where k = 3 or not exists (select 1 from v where v.lang = c.lang and v.phrase = c.phrase and 100 * v.a >= 50 * c.a)),
s as (select d.*, unnest(range(1, k)) as cut from d),
x as (select s.lang, s.phrase, s.a, s.cut, l.f as l, r.f as r, (1000000::hugeint * s.a * s.a // (l.f::hugeint * r.f))::bigint as score from s
  join f l on l.lang = s.lang and l.phrase = array_to_string(ws[1:cut], ' ') and l.k = cut join f r on r.lang = s.lang and r.phrase = array_to_string(ws[cut + 1:s.k], ' ') and r.k = s.k - cut),
m as (select * from x qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from m)
select lang, rank, phrase, a, l, r, n, score from o join n using (lang) where rank <= 2000"""


#: Rows of op12 on pages that have one article each, with the references that these tables have; no other markup within takes text away.
OP12_SQL = """
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') as x from pages),
b as (select page_id, url, regexp_replace(regexp_replace(x, '<(?:/?(?:p|h[1-6]|div|ul|li)|br)\\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') as x from a),
c as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&#(?:x27|39);', chr(39), 'g'), '&amp;?', '&', 'g') as x from b),
t as (select page_id, url, trim(regexp_replace(x, '[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) as text from c)
select page_id, url, text, length(text) as n_chars from t"""


def _op13_sql() -> str:
    """Rows of op13 by keeping, for each state, the least of all edit strings behind their costs."""
    edit = lambda x, cost, letter: f"(lpad((left({x}, 6)::int + {cost})::varchar, 6, '0') || substr({x}, 7) || '{letter}')"
    inserted = "least(u, {z}, {s}, {a}) as u, least(a, {u}) as a".format(**{x: edit(x, 5, "I") for x in "zsua"})
    anyone = "least(z, s, a)"
    return f"""
with recursive o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (select *, xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(key, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y: case when y >= 0 then xor(x, y) else xor(x >> 1, 3988292384 * (x & 1)) end)) % 20 as lot from o),
d as (select conv_id, turn, case when lot = 4 then 'user' else role end as role, case lot when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case lot when 0 then 0 when 3 then 2 else 1 end)) as copy from h),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from d),
q as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again, left(role, 1) as x, lag(left(role, 1)) over (partition by conv_id order by i) as before from n),
r as (select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when again then 'duplicate' when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as fault from q),
k as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum((fault = 'blank')::int) as blank, sum((fault = 'duplicate')::int) as duplicate, sum((fault = 'truncated')::int) as truncated,
  sum((before is not null and before || x not in ('su', 'ua', 'au'))::int) as illegal, max(i) as rows from r group by conv_id),
step(conv_id, i, z, s, u, a) as (select conv_id, 0::bigint, '000000', null::varchar, null::varchar, null::varchar from k union all
  select conv_id, i, {edit("z", 2, "D")},
    least({edit("s", 2, "D")}, case when stays and x = 's' then {edit("z", "t", "K")} end),
    least({edit("u", 2, "D")}, case when stays and x = 'u' then {edit(anyone, "t", "K")} end, case when stays then {edit(anyone, "(t + 1)", "R")} end),
    least({edit("a", 2, "D")}, case when stays and x = 'a' then {edit("u", "t", "K")} end, case when stays then {edit("u", "(t + 1)", "R")} end)
  from (select conv_id, i, x, stays, t, z, s, {inserted} from (select step.conv_id, r.i, r.x, r.fault not in ('blank', 'duplicate') as stays, case r.fault when 'truncated' then 5 else 0 end as t, z, s, {inserted} from step join r on r.conv_id = step.conv_id and r.i = step.i + 1))),
e as (select conv_id, least(z, a) as best from (select conv_id, z, s, {inserted} from (select conv_id, z, s, {inserted} from step join k using (conv_id) where i = rows))),
walk(conv_id, audit, p, i, last, said) as (select conv_id, substr(best, 7), 0::bigint, 0::bigint, '', []::varchar[] from e union all
  select w.conv_id, audit, p + 1, w.i + (c <> 'I')::bigint, case when c = 'D' then last when c = 'K' then r.x when last = 'u' then 'a' else 'u' end,
    case when c = 'D' then said else list_append(said, case when c = 'K' then r.role when last = 'u' then 'assistant' else 'user' end || ':' || case when c = 'I' then '' else r.text end) end
  from (select *, substr(audit, p + 1, 1) as c from walk where p < length(audit)) w join r on r.conv_id = w.conv_id and r.i = least(w.i + 1, (select max(rows) from k where k.conv_id = w.conv_id))),
f as (select conv_id, audit, sha256(array_to_string(said, chr(10))) as repaired_sha256 from walk where p = length(audit)),
c as (select distinct conv_id from conversations)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(left(best, 6)::bigint, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from c left join k using (conv_id) left join e using (conv_id) left join f using (conv_id)"""


ORACLES: dict[str, str] = {
    "op3_warc": OP3_SQL,
    "op5_suffix": OP5_SQL,
    "op6_decontam": OP6_SQL,
    "op7_chat": OP7_SQL,
    "op11_collocations": OP11_SQL,
    "op12_pagetext": OP12_SQL,
    "op13_repair": _op13_sql(),
}
