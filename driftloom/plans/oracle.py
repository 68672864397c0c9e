"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

from ..operators.evaluate import EXPECTED
from ..operators.inject import ASSURANCE, CERTAIN, ENTITIES, FIGURE, LEAPS, REPORTED, SWAPS
from . import scoring, wider

STEPS = """steps as (
  select cast(conv_id as varchar) as run_id, conv_id, turn, role, text, cast(turn as varchar) as step_id,
    row_number() over (partition by conv_id order by turn) - 1 as ordinal
  from conversations where regexp_matches(text, '\\S'))"""

BAG = """tok as (select run_id, ordinal, unnest(regexp_extract_all(lower(text), '\\S+')) as w from steps),
cnt as (select run_id, ordinal, w, cast(count(*) as double) as n from tok group by all),
nrm as (select run_id, ordinal, sqrt(sum(n * n)) as norm from cnt group by all),
pdot as (select a.run_id, a.ordinal, sum(a.n * b.n) as d from cnt a join cnt b on a.run_id = b.run_id and a.w = b.w and b.ordinal = a.ordinal - 1 group by all),
adot as (select a.run_id, a.ordinal, sum(a.n * b.n) as d from cnt a join cnt b on a.run_id = b.run_id and a.w = b.w and b.ordinal = 0 group by all),
drift as (
  select s.run_id, s.ordinal,
    case when s.ordinal > 0 then 1 - coalesce(p.d, 0) / (n.norm * m.norm) end as drift_prev,
    case when s.ordinal > 0 then 1 - coalesce(a.d, 0) / (n.norm * z.norm) end as drift_anchor
  from steps s join nrm n using (run_id, ordinal)
  left join nrm m on m.run_id = s.run_id and m.ordinal = s.ordinal - 1
  left join nrm z on z.run_id = s.run_id and z.ordinal = 0
  left join pdot p on p.run_id = s.run_id and p.ordinal = s.ordinal
  left join adot a on a.run_id = s.run_id and a.ordinal = s.ordinal),
mean as (select *, case when drift_prev is null and drift_anchor is null then 0.0 else (coalesce(drift_prev, 0) + coalesce(drift_anchor, 0)) / ((drift_prev is not null)::int + (drift_anchor is not null)::int) end as combined_drift from drift)"""

JUDGED = """wrd as (select run_id, ordinal, list_distinct(regexp_extract_all(lower(text), '\\S+')) as h from steps),
pre as (select *, lag(h) over (partition by run_id order by ordinal) as p from wrd),
ent as (select run_id, ordinal, case when p is not null then least(0.95, greatest(0.05, len(list_intersect(p, h))::double / greatest(len(h), 1))) end as entailment from pre)"""


def _hits(text: str, phrase: str) -> str:
    return f"((length({text}) - length(replace({text}, '{phrase}', ''))) // {len(phrase)})"


def certainty(source: str, keys: str) -> str:
    """Common table ``cert`` of the stand-in lexicon over ``source``."""
    return f"""c0 as (select {keys}, lower(text) as t0 from {source}),
c1 as (select *, {_hits("t0", "in the")} as concluded, replace(t0, 'in the', ' ') as t1 from c0),
c2 as (select *, {_hits("t1", "of the")} as hedged, replace(t1, 'of the', ' ') as t2 from c1),
c3 as (select *, {_hits("t2", "and the")} as sure, replace(t2, 'and the', ' ') as t3 from c2),
c4 as (select *, regexp_extract_all(t3, '[a-zA-ZÀ-ɏ-]+') as k from c3),
c5 as (select *, hedged + len(list_filter(k, lambda x: x in ('of', 'to'))) as hedge_hits, sure + len(list_filter(k, lambda x: x in ('the', 'and'))) as certainty_hits,
  concluded > 0 or len(list_filter(k, lambda x: x = 'that')) > 0 as conclusive from c4),
cert as (select {keys}, greatest(-1.0::double, least(1.0::double, (certainty_hits - hedge_hits)::double / greatest(len(k), 1) * 5.0)) as score, hedge_hits, certainty_hits, conclusive from c5)"""


SIGNALS = f"""{STEPS},
{BAG},
{JUDGED},
{certainty("steps", "run_id, ordinal")},
crt as (select *, case when ordinal > 0 then greatest(0.0::double, least(1.0::double, score - lag(score) over (partition by run_id order by ordinal))) else 0.0 end as certainty_delta from cert),
agg as (
  select s.run_id, s.conv_id, s.ordinal, s.turn, s.step_id, s.role, m.drift_prev, m.drift_anchor, m.combined_drift, e.entailment, c.score, c.certainty_delta, c.conclusive,
    (coalesce(case when drift_anchor is not null then combined_drift * 0.4::double end, 0) + coalesce((1 - entailment) * 0.4::double, 0) + coalesce(case when s.ordinal > 0 then certainty_delta * 0.2::double end, 0))
    / nullif((case when drift_anchor is not null then 0.4::double else 0 end) + (case when entailment is not null then 0.4::double else 0 end) + (case when s.ordinal > 0 then 0.2::double else 0 end), 0) as aggregate
  from steps s join mean m using (run_id, ordinal) join ent e using (run_id, ordinal) join crt c using (run_id, ordinal)),
sig as (
  select *, concat_ws(',', case when drift_prev > 0.8011 then 'drift_prev' end, case when drift_anchor > 0.8011 then 'drift_anchor' end,
    case when entailment < 0.3003 then 'entailment' end, case when aggregate > 0.6007 then 'aggregate' end) as codes from agg),
flg as (select *, codes <> '' as flagged from sig)"""

VERDICT = """ver as (
  select run_id, max(aggregate) as max_aggregate, min(entailment) as min_entailment, max(drift_anchor) as max_drift,
    concat_ws(',', case when max(aggregate) > 0.6007 then 'aggregate' end, case when min(entailment) < 0.0601 then 'entailment' end, case when max(drift_anchor) > 0.9513 then 'drift_anchor' end) as codes
  from flg group by run_id)"""


def classified(signals: str = "flg") -> str:
    """Common table ``cls`` of the four rule scores."""
    unit = "(2 * 0.8011::double)"
    return f"""msr as (
  select *, row_number() over w as rnk, lag(drift_anchor) over w as before
  from {signals} where drift_anchor is not null window w as (partition by run_id order by ordinal)),
jmp as (
  select *, case when drift_anchor > before then case when lower(role) = 'system' then least(1.0::double, least(1.0::double, (drift_anchor - before) / {unit}) * 1.5) else least(1.0::double, (drift_anchor - before) / {unit}) end end as leap,
    case when conclusive and entailment < 0.3003 then least(1.0::double, (0.3003::double - entailment) / 0.3003::double) end as bad from msr),
grp as (
  select run_id, avg(case when rnk <= 2 then drift_anchor end) as early, count(*) as n, sum((coalesce(drift_anchor > before, false))::int) as rises, max(bad) as bad, max(leap) as leap,
    sum(certainty_delta) as inflation, arg_min(drift_anchor, ordinal) as first, arg_max(drift_anchor, ordinal) as last, bool_or(flagged) as flagged from jmp group by run_id),
cls as (
  select run_id, flagged, greatest(0.0::double, least(1.0::double, (early - 0.8011::double) / {unit})) as retrieval,
    greatest(0.0::double, least(1.0::double, 0.7::double * coalesce(bad, 0) + 0.3::double * case when n > 1 then rises::double / (n - 1) else 0 end)) as inference,
    coalesce(leap, 0.0::double) as context_poisoning,
    greatest(0.0::double, least(1.0::double, inflation)) * case when n > 1 and last > first then 1.0::double else 0.5::double end as confidence_inflation from grp)"""


def _r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


def _draw(n: str, seed: int, key: str, *parts: str) -> str:
    tail = "".join(f"|{p}" for p in parts)
    return f"(('0x' || substr(md5('{seed}|' || {key} || '{tail}'), 1, 8))::bigint % ({n}))"


DENSE = """vec as (select cast(label as varchar) as run_id, embedding::double[] as v, row_number() over (partition by label order by vec_id) - 1 as ordinal from embeddings)"""

FACTS = "list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"

def _injected(kind: str, text: str) -> str:
    """Records of an injection; ``text`` is the changed text in SQL over ``t`` and ``run_id``."""
    return f"""with base as (
  select cast(conv_id as varchar) as run_id, turn, text as t, row_number() over (partition by conv_id order by turn) - 1 as nr, count(*) over (partition by conv_id) as n from conversations),
hit as (select * from base where n >= 3 and nr = {_draw("greatest(n - 2, 1)", 0, "run_id", kind, "index")} + 1)
select run_id, cast(turn as bigint) as step_index, '{kind}' as kind, t as original_text, {text} as injected_text from hit"""


def _pick(pool: tuple[str, ...], at: str) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in pool) + f"][{at} + 1]"


def _certain() -> str:
    text = "t"
    for hedge, word in CERTAIN.items():
        text = f"regexp_replace({text}, '(?i)\\b{hedge}\\b', '{word}', 'g')"
    hedged = "regexp_matches(t, '(?i)\\b(" + "|".join(CERTAIN) + ")\\b')"
    return f"case when {hedged} then {text} else '{ASSURANCE}' || lower(substr(t, 1, 1)) || substr(t, 2) end"


def signals(source: str = "conversations", anchored: bool = False, nli: bool = True) -> str:
    """The common tables up to ``flg`` with other settings: steps of another table, an anchor of its own and omission, or no entailment."""
    out = SIGNALS.replace("from conversations where", f"from {source} where")
    if source != "conversations":
        out = out.replace("select cast(conv_id as varchar) as run_id, conv_id", "select run_id, conv_id").replace("partition by conv_id order by turn", "partition by run_id order by turn")
    if not nli:
        out = out.replace("case when p is not null then least(0.95, greatest(0.05, len(list_intersect(p, h))::double / greatest(len(h), 1))) end as entailment", "null::double as entailment")
    if anchored:
        out = out.replace("case when s.ordinal > 0 then 1 - coalesce(a.d, 0) / (n.norm * z.norm) end as drift_anchor", "1 - coalesce(a.d, 0) / (n.norm * z.norm) as drift_anchor")
        out = out.replace("case when aggregate > 0.6007 then 'aggregate' end)", "case when aggregate > 0.6007 then 'aggregate' end, case when omission > 0.2503 then 'omission' end)")
        out = out.replace("join crt c using (run_id, ordinal)),\nsig as", "join crt c using (run_id, ordinal)),\n" + OMISSION + ",\nsig as").replace("as codes from agg)", "as codes from (select * from agg left join omi using (run_id, ordinal)))")
    return out


#: Facts of a run's first text, short sentences joined to the one before, and how many each step holds.
OMISSION = """prt as (select run_id, unnest(range(len(p))) as i, unnest(p) as f from (select run_id, @FACTS@ as p from steps where ordinal = 0)),
rns as (select *, sum(case when i = 0 or length(f) >= 25 then 1 else 0 end) over (partition by run_id order by i) as k from prt),
mrg as (select run_id, k, string_agg(f, ' ' order by i) as fact from rns group by run_id, k),
fcs as (select run_id, list(list_distinct(regexp_extract_all(lower(fact), '\\S+')) order by k) as facts from mrg where k <= 12 group by run_id),
cvg as (select w.run_id, w.ordinal, len(list_filter(t.facts, lambda f: least(0.95, greatest(0.05, len(list_intersect(w.h, f))::double / greatest(len(f), 1))) >= 0.2003))::double / len(t.facts) as coverage from wrd w join fcs t using (run_id)),
omi as (select *, greatest(0.0::double, lag(coverage, 1, 1.0) over (partition by run_id order by ordinal) - coverage) as omission from cvg)""".replace("@FACTS@", FACTS)

#: All kinds of injected runs; the name of an entity is the first that doesn't open a sentence.
_NAME = r"\b[A-Z][a-z]{2,}\b"
_OPEN = "regexp_replace(t, '(^|[.!?]\\s)[A-Z]', '\\1x', 'g')"


def _entity(key: str, seed: str = "0") -> str:
    names = "[" + ", ".join(f"'{e}'" for e in ENTITIES) + "]"
    found, at = f"regexp_extract({_OPEN}, '{_NAME}')", f"length(regexp_extract({_OPEN}, '^((?s:.*?)){_NAME}', 1))"
    others = f"list_filter({names}, lambda e: e <> {found})"
    pick = f"{others}[{_roll(f'len({others})', seed, key, 'entity_distortion', 'entity')} + 1]"
    return f"case when {found} <> '' then substr(t, 1, {at}) || {pick} || substr(t, {at} + length({found}) + 1) else t || '{REPORTED[0]}' || {names}[{_roll(str(len(ENTITIES)), seed, key, 'entity_distortion', 'entity')} + 1] || '{REPORTED[1]}' end"


def _roll(n: str, seed: str, key: str, *parts: str) -> str:
    tail = "".join(f"|{p}" for p in parts)
    return f"(('0x' || substr(md5(({seed}) || '|' || {key} || '{tail}'), 1, 8))::bigint % ({n}))"


def _numeric(key: str, seed: str = "0") -> str:
    f = "regexp_extract(t, '(\\d+(?:[.,]\\d+)?)', 1)"
    roll = lambda n, part: _roll(n, seed, key, "numeric_fabrication", part)
    forged = f"cast(floor(replace({f}, ',', '.')::double)::decimal(38,0)::hugeint * ({roll('6', 'factor')} + 3) + {roll('90', 'offset')} + 7 as varchar)"
    return f"case when {f} <> '' then substr(t, 1, strpos(t, {f}) - 1) || {forged} || substr(t, strpos(t, {f}) + length({f})) else t || '{FIGURE[0]}' || ({roll('8999', 'figure')} + 1000) || '{FIGURE[1]}' end"


def changed(seed: str = "0") -> str:
    """Common tables ``base`` and ``inj``: conversations of three or more turns with an error, of each kind."""
    key = "cast(conv_id as varchar)"
    texts = {
        "numeric_fabrication": _numeric(key, seed), "entity_distortion": _entity(key, seed), "certainty_inflation": _certain(),
        "causal_leap": "t || ' ' || " + _pick(LEAPS, _roll("4", seed, key, "causal_leap", "leap")), "context_swap": _pick(SWAPS, _roll("4", seed, key, "context_swap", "swap")),
    }
    each = [
        f"select {key} || '--{k}' as run_id, {key} as source_id, '{k}' as kind, conv_id, turn, role, n, t as original, ({hit}) as hit, case when {hit} then {x} else t end as text from base"
        for k, x in texts.items() for hit in [f"n >= 3 and nr = {_roll('greatest(n - 2, 1)', seed, key, k, 'index')} + 1"]
    ]
    return f"base as (select conv_id, turn, role, text as t, row_number() over (partition by conv_id order by turn) - 1 as nr, count(*) over (partition by conv_id) as n from conversations),\ninj as ({' union all '.join(each)})"


def _wider(sig: str, chosen: str, origin: str, matrix: str, cross: str, margin: str, consecutive: str, facts: str, held: str) -> dict[str, str]:
    wide = f"with {signals(anchored=True)}"
    six = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in ("drift_prev", "drift_anchor", "entailment", "aggregate", "omission", "coverage"))
    rnd = f"rnd as (select run_id, ordinal, turn, step_id, {six} from flg)"
    three = lambda c, n=3: f"printf('%.{n}f', round({c}, {n}))"
    over = lambda c, t: f"case when {c} > {t} then '{c} ' || {three(c)} || ' > threshold {t}' end"
    reasons = "concat_ws('; ', " + ", ".join([
        over("drift_prev", 0.8011), over("drift_anchor", 0.8011), f"case when entailment < 0.3003 then 'entailment ' || {three('entailment')} || ' < threshold 0.3003' end", over("aggregate", 0.6007),
        f"case when omission > 0.2503 then 'omission ' || {three('omission')} || ' > threshold 0.2503 (anchor-fact coverage ' || {three('coverage', 2)} || ')' end",
    ]) + ")"
    ext = """ext as (select run_id, max(struct_pack(v := aggregate, s := turn)) filter (aggregate is not null) as a, min(struct_pack(v := entailment, s := turn)) filter (entailment is not null) as e,
  max(struct_pack(v := omission, s := turn)) filter (omission is not null) as o, max(struct_pack(v := drift_anchor, s := turn)) filter (drift_anchor is not null) as d from rnd group by run_id)"""
    levels = (("a", "aggregate", "aggregate", ">", 0.6007), ("e", "entailment", "entailment collapse", "<", 0.0601), ("o", "omission", "omission", ">", 0.9007), ("d", "drift_anchor", "anchor drift", ">", 0.9513))
    codes = "concat_ws(',', " + ", ".join(f"case when {x}.v {s} {t} then '{c}' end" for x, c, _, s, t in levels) + ")"
    told = "concat_ws('; ', " + ", ".join(f"case when {x}.v {s} {t} then '{n} ' || {three(x + '.v')} || ' {s} {t} at step ' || {x}.s end" for x, _, n, s, t in levels) + ")"
    plain = f"with {signals(nli=False)}"
    quiet = classified().replace("greatest(0.0::double, least(1.0::double, 0.7::double * coalesce(bad, 0) + 0.3::double * case when n > 1 then rises::double / (n - 1) else 0 end)) as inference",
                                 "greatest(0.0::double, least(1.0::double, (case when n > 1 then rises::double / (n - 1) else 0 end) * case when anyc then 0.7::double else 0.4::double end)) as inference").replace("bool_or(flagged) as flagged from jmp", "bool_or(flagged) as flagged, bool_or(conclusive) as anyc from jmp")
    # CRC-32 of a word's bytes, eight shifts a byte.
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), cast(2 * i + 1 as int), 2))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295::bigint)"
    bucketed = f"with {STEPS}, {BAG}".replace("tok as (select run_id, ordinal, unnest(regexp_extract_all(lower(text), '\\S+')) as w from steps)", "raw as (select run_id, ordinal, unnest(regexp_extract_all(lower(text), '\\S+')) as w from steps), wds as (select w, " + crc + " % 128 as h from (select distinct w from raw)), tok as (select run_id, ordinal, h as w from raw join wds using (w))")
    blank = "(turn % 3 = 1 or conv_id % 10 = 0)"
    gaps = f"gap as (select conv_id, turn, role, case when {blank} then null else text end as text from conversations)"
    notes = f"""nts as (select cast(conv_id as varchar) as run_id, 1 as stage, turn as pos, 'skipped' as code, 'step ' || turn || ' skipped: empty or non-text content' as message from gap where text is null
  union all select cast(conv_id as varchar), 2, null, 'empty', 'no measurable steps in run' from gap group by conv_id having count(text) = 0)"""
    gapped = signals("gap2").replace("steps as (", f"{gaps},\ngap2 as (select cast(conv_id as varchar) as run_id, * from gap where text is not null),\nsteps as (", 1)
    truth = "tru as (select run_id, conv_id, count(*) as n, conv_id % 3 <> 0 as truth, conv_id % count(*) as origin from flg group by run_id, conv_id)"
    first = "fst as (select run_id, min(case when regexp_replace(codes, ',?omission', '') <> '' then ordinal end) as a, min(case when flagged then ordinal end) as b from flg group by run_id)"
    rules = ", ".join("(" + ", ".join(["'" + r[0] + "'", *["null::double" if x is None else f"{x}::double" for x in r[1:5]], "true" if r[5] else "false"]) + ")" for r in wider.RULES)
    expected = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in EXPECTED.items()) + " end"
    injected = f"with {changed()},\n{signals('inj').replace('where regexp_matches', 'where n >= 3 and regexp_matches')}"
    share = lambda c: f"round(avg(case when dual_nli then coalesce({c}, false)::int end), 6) + 0.0"
    count = lambda c: f"round(avg({c}::int), 6) + 0.0 as {c}"
    detection = f"""{injected}, {VERDICT}, {classified()}, {chosen}, {origin},
abl as (select run_id, coalesce(bool_or(drift_prev > 0.8011), false) as prev, coalesce(bool_or(drift_anchor > 0.8011), false) as anchor, coalesce(bool_or(aggregate > 0.6007), false) as dual_nli, coalesce(arg_max(drift_anchor, ordinal) > 0.8011, false) as naive from flg group by run_id),
prd as (select run_id, min(ordinal) as predicted from att where run_id in (select run_id from ver where codes <> '') group by run_id),
typ as (select run_id, list_transform(c, lambda x: x.t) as types from chs where run_id in (select run_id from ver where codes <> '')),
rec as (select run_id, kind, turn as actual from inj where hit),
det as (select *, prev or anchor as dual, list_contains(types, {expected}) as fits from rec join abl using (run_id) left join prd using (run_id) left join typ using (run_id))
select coalesce(kind, 'total') as kind, count(*) as n, {count('dual_nli')}, {count('dual')}, {count('prev')}, {count('anchor')}, {count('naive')}, {share('predicted = actual')} as exact, {share('abs(predicted - actual) <= 1')} as within1, {share('fits')} as right_type
from det group by grouping sets ((kind), ())"""
    steps_md5 = "md5(string_agg(turn || '|' || text, chr(10) order by turn))"
    dom = "dom as (select cast(conv_id as varchar) as source_id, arg_min(role, turn) as domain from conversations group by conv_id)"
    rescoring = f"""{sig}, {facts},
cov as (select w.run_id, w.ordinal, len(list_filter(t.facts, lambda f: {held} >= 0.2003))::double / len(t.facts) as coverage from wrd w join fct t using (run_id)),
los as (select *, greatest(0.0::double, lag(coverage, 1, 1.0) over (partition by run_id order by ordinal) - coverage) as lost from cov),
per as (select l.run_id, f.conv_id, count(*) as n, min(case when f.flagged then l.ordinal end) as a, min(case when f.flagged or l.lost > 0.2503 then l.ordinal end) as b from los l join flg f using (run_id, ordinal) group by l.run_id, f.conv_id),
lab as (select *, conv_id % n as m, (conv_id * 3) % n as ann, case when conv_id % 2 = 0 then (conv_id * 3) % n else conv_id % n end as bob from per where conv_id % 3 <> 0),
tru as (select run_id, a, b, 'machine' as basis, m as origin from lab union all select run_id, a, b, 'resolved', case when ann = bob then ann else m end from lab),
prd as (select basis, false as omission, a as predicted, origin from tru union all select basis, true, b, origin from tru)
select basis, omission, count(*) as n, round(avg(coalesce(predicted = origin, false)::int), 6) + 0.0 as exact, round(avg(coalesce(abs(predicted - origin) <= 1, false)::int), 6) + 0.0 as within1 from prd group by basis, omission"""
    return {
        "omission_signals": f"{wide} select run_id, ordinal, {_r6('drift_anchor', 'coverage', 'omission', 'aggregate')}, codes from flg",
        "flag_reasons": f"{wide}, {rnd}, r as (select run_id, ordinal, {reasons} as reasons from rnd) select run_id, ordinal, reasons, reasons <> '' as flagged from r",
        "verdict_reasons": f"{wide}, {rnd}, {ext}, v as (select run_id, {codes} as codes, {told} as reasons from ext) select run_id, codes <> '' as verdict, codes, reasons from v",
        "drift_only_signals": f"{plain} select run_id, ordinal, {_r6('aggregate')}, codes from flg",
        "drift_only_scores": f"{plain}, {quiet} select run_id, {_r6('retrieval', 'inference', 'context_poisoning', 'confidence_inflation')} from cls",
        "drift_buckets": f"{bucketed} select run_id, ordinal, {_r6('drift_prev', 'drift_anchor')} from drift where ordinal > 0",
        "softmax_labels": f"""with l as (select vec_id, embedding[1]::double as e, embedding[2]::double as n, embedding[3]::double as c from embeddings), s as (select vec_id, exp(e - greatest(e, n, c)) as e, exp(n - greatest(e, n, c)) as n, exp(c - greatest(e, n, c)) as c from l)
select vec_id, round(e / (e + n + c), 6) + 0.0 as entailment, round(n / (e + n + c), 6) + 0.0 as neutral, round(c / (e + n + c), 6) + 0.0 as contradiction, case when e >= n and e >= c then 'entailment' when n >= c then 'neutral' else 'contradiction' end as label from s""",
        "truncated_steps": "select doc_id from documents where not regexp_matches(text, '[.!?\")%][\\s\\x0b\\p{Z}]*$')",
        "squeezed_texts": "select doc_id, md5(trim(regexp_replace(text, '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+', ' ', 'g'))) as squeezed_md5 from documents",
        "text_predicates": "select doc_id, cast(doc_id % 13 as bigint) as batch, contains(lower(text), ' der ') or contains(lower(text), ' und ') as second_language from documents",
        "skip_notes": f"with {gaps}, {notes} select run_id, code, cast(pos as bigint) as pos, message from nts",
        "report_notes": f"""with {gapped}, {VERDICT}, {notes}, n as (select run_id, string_agg(message, '; ' order by stage, pos) as notes from nts group by run_id), s as (select run_id, count(*) as n_steps, bool_or(entailment is not null) as judged from flg group by run_id)
select r.run_id, coalesce(n_steps, 0) as n_steps, coalesce(notes, '') as notes, coalesce(ver.codes <> '', false) as verdict, not coalesce(judged, false) as degraded, true as monitored
from (select distinct cast(conv_id as varchar) as run_id from conversations) r left join s using (run_id) left join n using (run_id) left join ver using (run_id)""",
        "report_reasons": f"""{sig}, {VERDICT}, bad as (select f.* from flg f join ver using (run_id) where ver.codes <> ''), {classified("bad")}, {chosen.replace("round(", "(").replace(", 6)", ")")}, {origin.replace("from flg", "from bad")},
o as (select run_id, string_agg(step_id || ':' || printf('%.3f', round(case when k = 1 then least(1.0::double, plain + 0.1) else plain end, 3)), ',' order by ordinal) as origins from att group by run_id)
select ver.run_id, ver.codes <> '' as verdict, coalesce(array_to_string(list_transform(chs.c, lambda x: x.t), ','), '') as types, coalesce(origins, '') as origins, (select count(*) from flg f where f.run_id = ver.run_id and f.flagged) as n_flagged, 0.8011::double as drift_threshold,
  case when (select bool_or(entailment is not null) from flg f where f.run_id = ver.run_id) then 'word overlap' end as nli from ver left join chs using (run_id) left join o using (run_id)""",
        "signal_ranking": f"""{wide}, s as (select distinct run_id, ordinal, unnest(list_transform(string_split(codes, ','), lambda c: case when c like 'drift%' then 'drift' else c end)) as signal from flg where flagged), c as (select signal, count(*) as n from s group by signal)
select signal, n, row_number() over (order by n desc, signal) as place from c""",
        "holdout_calibrated": f"""{sig}, p as (select run_id, row_number() over (order by conv_id) <= 15 as early from (select distinct run_id, conv_id from flg)),
q as (select quantile_cont(drift_prev, 0.95) as p, quantile_cont(drift_anchor, 0.95) as a, quantile_cont(aggregate, 0.95) as g from flg join p using (run_id) where early),
v as (select run_id, coalesce(bool_or(drift_prev > q.p), false) as prev, coalesce(bool_or(drift_anchor > q.a), false) as anchor, coalesce(bool_or(aggregate > q.g), false) as dual_nli from flg join p using (run_id), q where not early group by run_id)
select count(*) as n, count(*) filter (where prev) as prev, count(*) filter (where anchor) as anchor, count(*) filter (where prev or anchor) as dual, count(*) filter (where dual_nli) as dual_nli from v""",
        "omission_before_after": f"""{wide}, {truth}, {first}, j as (select *, abs(a - origin) as da, abs(b - origin) as db from fst join tru using (run_id))
select count(*) filter (where truth) as n, count(*) filter (where not truth) as n_clean, count(*) filter (where truth and a is not null) as found_without, count(*) filter (where truth and da = 0) as exact_without, count(*) filter (where truth and da <= 1) as within1_without, count(*) filter (where not truth and a is not null) as clean_without,
count(*) filter (where truth and b is not null) as found_with, count(*) filter (where truth and db = 0) as exact_with, count(*) filter (where truth and db <= 1) as within1_with, count(*) filter (where not truth and b is not null) as clean_with,
count(*) filter (where truth and a is null and b is not null) as gained, count(*) filter (where truth and db < da) as improved from j""",
        "attribution_rescoring": rescoring,
        "rule_sweep": f"""{wide}, {consecutive}, x as (select run_id, max(aggregate) as a, min(entailment) as e, max(drift_anchor) as d, max(omission) as o from flg group by run_id), r(rule, ra, re, rd, ro, rc) as (values {rules}),
f as (select rule, run_id::bigint % 3 = 0 as truth, coalesce(a > ra, false) or coalesce(e < re, false) or coalesce(d > rd, false) or coalesce(o > ro, false) or (consecutive and rc) as fired from x join con using (run_id), r)
select rule, count(*) filter (where truth) as n_true, count(*) filter (where truth and fired) as recall, count(*) filter (where not truth) as n_clean, count(*) filter (where not truth and fired) as false_alarms from f group by rule""",
        "threshold_sweep_roles": matrix.replace("f.flagged or l.lost > l.omit as hit", "f.flagged or (l.lost > l.omit and coalesce(lower(f.role) <> 'assistant', true)) as hit") + f" select cover, omit, {_r6('exact', 'within1', 'fp_steps')}, fp_runs from swp",
        "ingested_steps": f"""{PAYLOADS} select run_id, pos, case k when 1 then cast(pos as varchar) when 2 then 's' || turn else cast(turn as varchar) end as step_id, case when k < 2 then role end as role, case when k = 5 then 'audio' else 'text' end as modality,
  case k when 1 then 'a,tool' when 5 then 'metadata' else '' end as metadata_keys, case when k in (0, 1, 5) then text else '' end as text from p where k <> 3""",
        "ingest_notes": f"""{PAYLOADS} select run_id, pos, case k when 1 then 'no_step_id' when 2 then 'text_not_string' when 3 then 'not_an_object' when 4 then 'no_text' else 'odd_metadata' end as code,
  case k when 1 then 'step at position ' || pos || ': missing step_id, assigned ' || pos when 2 then 'step s' || turn || ': text is not a string, treated as empty' when 3 then 'payload at position ' || pos || ' ignored: not an object'
  when 4 then 'step ' || turn || ': missing text (will be skipped in measurement)' else 'step ' || turn || ': metadata is not an object, kept under its name' end as message from p where k > 0""",
        "payload_files": "select conv_id || case when conv_id % 2 = 0 then '.jsonl' else '.json' end as run_id, row_number() over (partition by conv_id order by turn) - 1 as pos, cast(turn as varchar) as step_id, role, text from conversations",
        "array_ranges": "select cast(conv_id as varchar) as run_id, row_number() over (partition by conv_id order by turn) - 1 as pos, cast(turn as varchar) as step_id, role, text from conversations",
        "files_put_aside": """select conv_id || '.json' as run_id, case when arg_max(role, turn) = 'user' then 0 else count(*) end as n_steps,
case when arg_max(role, turn) = 'user' then 'file put aside: not a JSON array of steps: ' || conv_id || '.json' else '' end as message from conversations group by conv_id""",
        "report_documents": f"{sig}, {VERDICT}, s as (select run_id, count(*) as n_steps, bool_or(entailment is not null) as judged, arg_min(step_id, ordinal) as first_step from flg group by run_id) select run_id, codes <> '' as verdict, n_steps, case when judged then 'word overlap' end as nli, first_step from ver join s using (run_id)",
        "detection_by_kind": detection,
        "inject_entity_step": _injected("entity_distortion", _entity("run_id")),
        "dataset_clean": f"with {dom} select source_id as id, domain, count(*) as n_steps, {steps_md5} as steps_md5 from conversations join dom on source_id = cast(conv_id as varchar) group by source_id, domain",
        "dataset_injected": f"""with {changed('conv_id * 7 + 1')}, {dom}, m as (select run_id, {steps_md5} as steps_md5 from inj group by run_id)
select i.run_id as id, i.source_id, domain, kind as injection_kind, cast(turn as varchar) as origin_step_id, cast(turn as bigint) as origin_step_index, original as original_text, text as injected_text, steps_md5, conv_id * 7 + 1 as seed from inj i join m using (run_id) join dom on dom.source_id = i.source_id where hit""",
        "dataset_labelled": """with c as (select conv_id, cast(conv_id as varchar) as id, arg_min(text, turn) as q, arg_max(text, turn) as s, count(*) as n from conversations group by conv_id)
select id, md5(q) as question_md5, md5(s) as source_md5, 'm' as model, 0.7::double as temperature, n as n_steps, case when conv_id % 5 <> 4 then conv_id % 3 <> 0 end as cascade_occurred, case when conv_id % 5 <> 4 then conv_id % n end as origin_step,
case when conv_id % 5 <> 4 then 'said so' else '' end as evidence, '' as annotation_notes, case when conv_id % 5 <> 4 then 'consensus' else 'machine_only' end as label_agreement,
case when conv_id % 2 = 0 then 'ann:' || (conv_id % n) || ',bob:' || (conv_id % n + (conv_id % 4 = 0)::int) end as annotator_labels from c""",
    }


#: Payloads by the kind that their turn's number gives them; the third kind is no object and takes no position.
PAYLOADS = """with p as (select cast(conv_id as varchar) as run_id, turn, role, text, turn % 6 as k, coalesce(sum((turn % 6 <> 3)::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as pos from conversations)"""


def build() -> dict[str, str]:
    bag = f"with {STEPS}, {BAG}"
    sig = f"with {SIGNALS}"
    runs = f"{sig}, {VERDICT}"
    ratio = lambda a, b: f"(1 - case when sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) = 0 then 0 else list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) end)"
    ranked = "[{'m': -round(retrieval, 6), 'r': 0, 't': 'retrieval'}, {'m': -round(inference, 6), 'r': 1, 't': 'inference'}, {'m': -round(context_poisoning, 6), 'r': 2, 't': 'context_poisoning'}, {'m': -round(confidence_inflation, 6), 'r': 3, 't': 'confidence_inflation'}]"
    chosen = f"srt as (select run_id, flagged, list_sort({ranked}) as s from cls), chs as (select run_id, case when len(list_filter(s, lambda x: -x.m >= 0.4)) > 0 then list_filter(s, lambda x: -x.m >= 0.4) when flagged then list_filter(s[1:1], lambda x: -x.m > 0) else [] end as c from srt)"
    cross = "((coalesce(drift_prev > 0.8011, false))::int + (coalesce(drift_anchor > 0.8011, false))::int + (coalesce(entailment < 0.3003, false))::int)"
    margin = "greatest(case when drift_prev > 0.8011 then (drift_prev - 0.8011::double) / 0.8011::double end, case when drift_anchor > 0.8011 then (drift_anchor - 0.8011::double) / 0.8011::double end, case when entailment < 0.3003 then (0.3003::double - entailment) / 0.3003::double end)"
    origin = f"org as (select *, {cross} as crossed, {margin} as margin from flg where {cross} > 0), att as (select *, row_number() over (partition by run_id order by ordinal) as k, 0.6::double * crossed / 3 + 0.4::double * least(1.0::double, margin) as plain from org)"
    facts = f"fct as (select run_id, list_transform({FACTS}[:12], lambda f: list_distinct(regexp_extract_all(lower(f), '\\S+'))) as facts from steps where ordinal = 0)"
    held = "least(0.95, greatest(0.05, len(list_intersect(w.h, f))::double / greatest(len(f), 1)))"
    consecutive = "con as (select run_id, bool_or(pair) as consecutive from (select run_id, flagged and coalesce(lead(flagged) over (partition by run_id order by ordinal), false) as pair from flg) group by run_id)"
    matrix = f"""{sig}, {facts},
grid as (select c as cover, o as omit from (select unnest([0.0701, 0.1001, 0.1503, 0.2003, 0.2507, 0.3003, 0.4007]::double[]) as c), (select unnest([0.0503, 0.1501, 0.2003, 0.2503, 0.3401, 0.5007, 0.6703]::double[]) as o)),
cov as (select w.run_id, w.ordinal, g.cover, g.omit, len(list_filter(t.facts, lambda f: {held} >= g.cover))::double / len(t.facts) as coverage from wrd w join fct t using (run_id), grid g),
los as (select *, greatest(0.0::double, lag(coverage, 1, 1.0) over (partition by run_id, cover, omit order by ordinal) - coverage) as lost from cov),
onn as (select l.*, f.flagged or l.lost > l.omit as hit, f.conv_id from los l join flg f using (run_id, ordinal)),
per as (select run_id, conv_id, cover, omit, min(case when hit then ordinal end) as first, count(*) as n, sum(hit::int) as hits from onn group by all),
tru as (select *, conv_id % 3 <> 0 as truth, conv_id % n as origin from per),
swp as (select cover, omit, avg(case when truth then coalesce(first = origin, false)::int end) as exact, avg(case when truth then coalesce(abs(first - origin) <= 1, false)::int end) as within1,
  coalesce(coalesce(sum(case when not truth then hits end), 0) / nullif(sum(case when not truth then n else 0 end), 0), 0.0) as fp_steps, count(*) filter (where not truth and hits > 0) as fp_runs from tru group by cover, omit)"""
    sample = """qta as (select lang, source, count(*) as n, count(*) * 40.0::double / (select count(*) from documents) as exact from documents group by lang, source),
bas as (select *, floor(exact)::int as base from qta),
tak as (select *, base + (row_number() over (order by round(exact - base, 9) desc, lang, source) <= 40 - (select sum(base) from bas))::int as take from bas),
rnk as (select doc_id, lang, source, row_number() over (partition by lang, source order by md5('0|' || doc_id), doc_id) as k from documents),
smp as (select r.doc_id, r.lang, r.source from rnk r join tak t using (lang, source) where k <= take)"""
    passes = """hum as (select doc_id as item_id, 'ann' as rater, cast(quality as bigint) as label from labels union all select doc_id, 'bob', cast(toxic as bigint) from labels)"""
    out = {
        "measurable_steps": f"with {STEPS} select run_id, cast(ordinal as int) as ordinal, cast(turn as int) as pos, step_id, role from steps",
        "drift_prev_bow": f"{bag} select run_id, ordinal, {_r6('drift_prev')} from drift where ordinal > 0",
        "drift_anchor_bow": f"{bag} select run_id, ordinal, {_r6('drift_anchor', 'combined_drift')} from mean",
        "drift_given_anchor": f"""{bag}, lst as (select run_id, max(ordinal) as o from steps group by run_id),
giv as (select run_id, w, sum(n) / 2 as g from (select c.* from cnt c where ordinal = 0 union all select c.* from cnt c join lst on c.run_id = lst.run_id and c.ordinal = lst.o) group by all),
gn as (select run_id, sqrt(sum(g * g)) as gnorm from giv group by run_id),
gd as (select c.run_id, c.ordinal, sum(c.n * g.g) as d from cnt c join giv g using (run_id, w) group by all)
select s.run_id, s.ordinal, {_r6('drift_prev')}, round(1 - coalesce(gd.d, 0) / (n.norm * gn.gnorm), 6) + 0.0 as drift_anchor
from drift s join nrm n using (run_id, ordinal) join gn using (run_id) left join gd using (run_id, ordinal)""",
        "drift_dual_dense": f"""with {DENSE}, lgd as (select *, lag(v) over w as p, first_value(v) over w as a from vec window w as (partition by run_id order by ordinal))
select run_id, ordinal, case when p is not null then round({ratio('v', 'p')}, 6) + 0.0 end as drift_prev, case when ordinal > 0 then round({ratio('v', 'a')}, 6) + 0.0 end as drift_anchor from lgd""",
        "drift_consensus_anchor": f"""with {DENSE}, each as (select run_id, generate_subscripts(v, 1) as i, unnest(v) as x from vec), mns as (select run_id, i, avg(x) as m from each group by all),
anc as (select run_id, list(m order by i) as a from mns group by run_id)
select run_id, ordinal, round({ratio('v', 'a')}, 6) + 0.0 as drift_anchor from vec join anc using (run_id)""",
        "max_drift_step": f"{bag}, rnd as (select run_id, ordinal, round(combined_drift, 6) + 0.0 as c from mean where drift_anchor is not null), num as (select *, row_number() over (partition by run_id order by c desc, ordinal) as k from rnd) select run_id, ordinal, c as combined_drift from num where k = 1",
        "drift_flags": f"{bag}, cod as (select run_id, ordinal, concat_ws(',', case when drift_prev > 0.8011 then 'drift_prev' end, case when drift_anchor > 0.8011 then 'drift_anchor' end) as codes from drift) select * from cod where codes <> ''",
        "entailment_overlap": f"with {STEPS}, {JUDGED} select run_id, ordinal, round(entailment, 6) + 0.0 as entailment, round((1 - entailment) * 0.7::double, 6) + 0.0 as neutral, round((1 - entailment) * 0.3::double, 6) + 0.0 as contradiction from ent where entailment is not null",
        "certainty_signal": f"with {certainty('documents', 'doc_id')} select doc_id, {_r6('score')}, hedge_hits, certainty_hits, conclusive from cert",
        "certainty_delta": f"{sig} select run_id, ordinal, {_r6('score', 'certainty_delta')} from crt",
        "facts_split": f"with f as (select doc_id, {FACTS} as facts from documents) select doc_id, cast(unnest(range(len(facts))) as int) as fact_idx, unnest(facts) as fact from f",
        "coverage_omission": f"""with {STEPS}, {JUDGED}, {facts}, cov as (select w.run_id, w.ordinal, len(list_filter(t.facts, lambda f: {held} >= 0.2003))::double / len(t.facts) as coverage from wrd w join fct t using (run_id))
select run_id, ordinal, round(coverage, 6) + 0.0 as coverage, round(greatest(0.0::double, lag(coverage, 1, 1.0) over (partition by run_id order by ordinal) - coverage), 6) + 0.0 as omission from cov""",
        "aggregate_score": f"{sig} select run_id, ordinal, {_r6('aggregate')}, flagged, codes from flg",
        "verdicts": f"{runs} select run_id, codes <> '' as verdict, codes from ver",
        "verdict_extremes": f"""{sig}, rnd as (select run_id, turn, round(aggregate, 6) + 0.0 as a, round(entailment, 6) + 0.0 as e, round(drift_anchor, 6) + 0.0 as d from flg),
ext as (select run_id, max(struct_pack(v := a, s := turn)) filter (a is not null) as a, min(struct_pack(v := e, s := turn)) filter (e is not null) as e, max(struct_pack(v := d, s := turn)) filter (d is not null) as d from rnd group by run_id)
select run_id, a.v as aggregate_value, a.s as aggregate_step, e.v as entailment_value, e.s as entailment_step, d.v as drift_anchor_value, d.s as drift_anchor_step from ext""",
        "classify_scores": f"{sig}, {classified()} select run_id, {_r6('retrieval', 'inference', 'context_poisoning', 'confidence_inflation')} from cls",
        "classification": f"{sig}, {classified()}, {chosen} select run_id, array_to_string(list_transform(c, lambda x: x.t), ',') as types from chs",
        "attribution": f"{sig}, {origin} select run_id, ordinal, step_id, cast(crossed as bigint) as crossed, round(case when k = 1 then least(1.0::double, plain + 0.1) else plain end, 3) as confidence from att",
        "report_summary": f"""{runs}, bad as (select f.* from flg f join ver using (run_id) where ver.codes <> ''), {classified("bad")}, {chosen}, {origin.replace("from flg", "from bad")},
stp as (select run_id, count(*) as n_steps, bool_or(entailment is not null) as judged from flg group by run_id), o as (select run_id, count(*) as n, min(struct_pack(o := ordinal, s := step_id)).s as s from att group by run_id)
select stp.run_id, ver.codes <> '' as verdict, n_steps, coalesce(len(chs.c), 0) as n_types, coalesce(o.n, 0) as n_origins, o.s as first_origin, not judged as degraded
from stp join ver using (run_id) left join chs using (run_id) left join o using (run_id)""",
        "calibrate_percentile": f"{bag}, v as (select drift_prev as x from drift where drift_prev is not null union all select drift_anchor from drift where drift_anchor is not null) select round(quantile_cont(x, 0.95), 4) as drift_threshold, count(*) as n_measurements, round(avg(x), 4) as drift_mean, round(stddev_pop(x), 4) as drift_std from v",
        "signal_percentiles": f"{sig}, q as (select quantile_cont(drift_prev, 0.95) as drift_prev, quantile_cont(drift_anchor, 0.95) as drift_anchor, quantile_cont(aggregate, 0.95) as aggregate, quantile_cont(entailment, 0.05) as entailment from flg) select {_r6('drift_prev', 'drift_anchor', 'aggregate', 'entailment')}, round(greatest(drift_prev, drift_anchor), 6) + 0.0 as drift_threshold from q",
        "holdout_rates": f"{sig}, f as (select conv_id, bool_or(flagged) as fired from flg group by conv_id), p as (select *, case when row_number() over (order by conv_id) <= 15 then 'calibrate' else 'holdout' end as part from f) select part, count(*) as n, count(*) filter (where fired) as n_fired from p group by part",
        "ablation_variants": f"{sig} select run_id, coalesce(bool_or(drift_prev > 0.8011), false) as prev, coalesce(bool_or(drift_anchor > 0.8011), false) as anchor, coalesce(bool_or(drift_prev > 0.8011), false) or coalesce(bool_or(drift_anchor > 0.8011), false) as dual, coalesce(bool_or(aggregate > 0.6007), false) as dual_nli from flg group by run_id",
        "naive_baseline": f"{bag}, l as (select run_id, arg_max_null(drift_anchor, ordinal) as distance from drift group by run_id) select run_id, {_r6('distance')}, coalesce(distance > 0.8011, false) as naive from l",
        "consecutive_flags": f"{sig}, {consecutive} select run_id, consecutive from con",
        "signal_counts": f"{sig}, s as (select distinct run_id, ordinal, unnest(list_transform(string_split(codes, ','), lambda c: case when c like 'drift%' then 'drift' else c end)) as signal from flg where flagged) select signal, count(*) as n from s group by signal",
        "threshold_sweep": f"{matrix} select cover, omit, {_r6('exact', 'within1', 'fp_steps')}, fp_runs from swp",
        "best_setting": f"{matrix}, r as (select cover, omit, {_r6('exact', 'within1', 'fp_steps')}, fp_runs from swp) select * from r order by within1 desc, fp_steps, cover desc, omit desc limit 1",
        "first_flag_accuracy": f"""{sig}, n as (select run_id, count(*) as n from steps group by run_id having count(*) >= 3), p as (select run_id, min(case when flagged then ordinal end) as predicted from flg group by run_id),
a as (select n.run_id, {_draw("n - 2", 0, "n.run_id", "origin")} + 1 as actual, predicted from n join p using (run_id))
select count(*) as n, round(avg(coalesce(predicted = actual, false)::int), 6) + 0.0 as exact, round(avg(coalesce(abs(predicted - actual) <= 1, false)::int), 6) + 0.0 as within1 from a""",
        "kappa_quality_toxic": """with c as (select quality as a, toxic as b, count(*) as n from labels where quality is not null and toxic is not null group by all), t as (select sum(n) as n, sum(case when a = b then n else 0 end) as same from c),
s as (select sum(x.na * y.nb) as p from (select a as k, sum(n) as na from c group by a) x join (select b as k, sum(n) as nb from c group by b) y using (k)), k as (select n, same / n as observed, p / (n * n) as expected from t, s)
select cast(n as bigint) as n, round(observed, 6) + 0.0 as observed, round(expected, 6) + 0.0 as expected, round((observed - expected) / (1 - expected), 6) + 0.0 as kappa from k""",
        "label_distribution": """with r as (select quality, lang, source from labels join documents using (doc_id)), g as (select quality, lang, source, count(*) as n, grouping(quality, lang, source) as g from r group by grouping sets ((quality), (quality, lang), (quality, source)))
select quality, lang, source, n, round(n / sum(n) over (partition by g, lang, source), 6) + 0.0 as share from g""",
        "label_resolution": f"""with {passes}, m as (select doc_id as item_id, doc_id % 2 as m from documents), a as (select item_id, label from hum where rater = 'ann' and label is not null), b as (select item_id, label from hum where rater = 'bob' and label is not null),
j as (select m.item_id, m, a.label as a, b.label as b from m left join a using (item_id) left join b using (item_id))
select item_id, case when a is null and b is null then m when a is null then b when b is null then a when a = b then a else m end as label,
case when a is null and b is null then 'machine_only' when a is null then 'single:bob' when b is null then 'single:ann' when a = b then 'consensus' when a = m or b = m then 'disputed:majority' else 'disputed:unresolved' end as agreement from j""",
        "rater_agreement": f"""with {passes}, e as (select h.* from hum h where item_id in (select doc_id from documents))
select a.rater as rater_a, b.rater as rater_b, count(*) as n, count(*) filter (where coalesce(abs(a.label - b.label) <= 1, a.label is null and b.label is null)) as near, count(*) filter (where a.label = b.label) as same
from e a join e b on a.item_id = b.item_id and a.rater < b.rater group by all""",
        "stratified_sample": f"with {sample} select doc_id, lang, source from smp",
        "balanced_split": f"""with {sample}, rst as (select doc_id, lang, source from documents where doc_id not in (select doc_id from smp)),
num as (select *, row_number() over (order by lang, source, md5('1|' || doc_id), doc_id) - 1 as k from rst) select doc_id, lang, source, k % 2 as part from num""",
        "form_upsert": "select doc_id, quality from documents left join labels using (doc_id)",
        "inject_numeric": f"""with d as (select doc_id, text as t, regexp_extract(text, '(\\d+(?:[.,]\\d+)?)', 1) as f, cast(doc_id as varchar) as k from documents)
select doc_id, md5(case when f <> '' then substr(t, 1, strpos(t, f) - 1) || cast(floor(replace(f, ',', '.')::double)::decimal(38,0)::hugeint * ({_draw("6", 0, "k", "numeric_fabrication", "factor")} + 3) + {_draw("90", 0, "k", "numeric_fabrication", "offset")} + 7 as varchar) || substr(t, strpos(t, f) + length(f))
else t || ' The measured figure is exactly ' || ({_draw("8999", 0, "k", "numeric_fabrication", "figure")} + 1000) || ' units.' end) as injected_md5 from d""",
        "index_quantiles": """with v as (select label, list_sort(list(embedding[1]::double)) as v from embeddings group by label)
select cast(label as bigint) as label, round(v[1], 6) + 0.0 as low, round(v[len(v) // 4 + 1], 6) + 0.0 as p25, round(v[len(v) // 2 + 1], 6) + 0.0 as middle, round(v[-1], 6) + 0.0 as high from v""",
        "inject_causal_step": _injected("causal_leap", "t || ' ' || " + _pick(LEAPS, _draw("4", 0, "run_id", "causal_leap", "leap"))),
        "inject_swap_step": _injected("context_swap", _pick(SWAPS, _draw("4", 0, "run_id", "context_swap", "swap"))),
        "inject_certainty_step": _injected("certainty_inflation", _certain()),
    }
    out["stream_drift_replay"] = f"""{bag}, f as (select run_id, ordinal, drift_prev, drift_anchor, coalesce(drift_prev > 0.8011 or drift_anchor > 0.8011, false) as flagged from drift)
select run_id, ordinal, cast(turn as varchar) as step_id, {_r6('drift_prev', 'drift_anchor')}, flagged, flagged as fresh, '' as note from f join (select run_id, ordinal, turn from steps) using (run_id, ordinal)"""
    whole = sig.replace(STEPS, """steps as (select 'all' as run_id, conv_id, turn, role, text, concat_ws('.', conv_id, turn) as step_id, row_number() over (order by conv_id, turn) - 1 as ordinal from conversations where regexp_matches(text, '\\S'))""")
    out["long_run_signals"] = f"{whole} select run_id, ordinal, step_id, {_r6('drift_prev', 'drift_anchor', 'entailment', 'certainty_delta', 'aggregate')}, flagged, codes from flg"
    out["long_run_scores"] = f"""{whole}, {VERDICT}, {classified()}, {origin}, {consecutive},
ogs as (select run_id, count(*) as n_origins, arg_min(step_id, ordinal) as first_origin, max(round(case when k = 1 then least(1.0::double, plain + 0.1) else plain end, 3)) as top_confidence from att group by run_id)
select run_id, {_r6('retrieval', 'inference', 'context_poisoning', 'confidence_inflation')}, n_origins, first_origin, top_confidence, codes, consecutive from cls join ogs using (run_id) join ver using (run_id) join con using (run_id)"""
    counts = ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::double" for c in scoring.LETTERS)
    out["model_scores_kept"] = f"""with {STEPS},
v as (select run_id, ordinal, text, [{counts}, 1.0::double] as v from steps),
p as (select *, lag(v) over w as pv, first(v) over w as av, lag(text) over w as pt from v window w as (partition by run_id order by ordinal)),
s as (select run_id, ordinal, 1 - list_cosine_similarity(v, pv) as drift_prev, case when ordinal > 0 then 1 - list_cosine_similarity(v, av) end as drift_anchor, least(length(pt), length(text))::double / greatest(length(pt), length(text)) as entailment from p)
select run_id, ordinal, {_r6('drift_prev', 'drift_anchor')}, case when ordinal > 0 then round(entailment, 6) + 0.0 end as entailment, true as scored, 0::bigint as scored_again from s"""
    unjudged = lambda p, h: f"(length({p}) % {scoring.ODD} = 0 or length({p}) % {scoring.ROUND} = 0 and length({h}) < 200)"
    out["failure_scopes"] = f"""with {STEPS},
p as (select *, lag(text) over (partition by run_id order by ordinal) as pt from steps),
fact as (select run_id, unnest({FACTS}[:12]) as f from steps where ordinal = 0),
a as (select run_id, count(*) as n, bool_or(length(text) > {scoring.TOO_LONG}) as failed, coalesce(bool_or(pt is not null and {unjudged('pt', 'text')}), false) as unjudged, bool_or(pt is not null) as pairs from p group by run_id),
c as (select s.run_id, bool_or({unjudged('s.text', 'f.f')}) as uncovered from steps s join fact f using (run_id) group by s.run_id)
select run_id, failed, case when failed then 'ValueError: text too long' else '' end as why, failed or unjudged or not pairs as degraded, case when failed then 0 else n end as n_steps,
  not failed and uncovered is not null and not uncovered as covered, unjudged, coalesce(uncovered, false) as uncovered, case when not unjudged and pairs then 'model' else '' end as nli
from a left join c using (run_id)"""
    out["push_log_replay"] = f"""with ev as (select cast(conv_id as varchar) as run_id, ((conv_id * 7 + turn * 5) % 3 * 3 + turn) * 100 + turn as idx, turn as pos, 's' || cast(turn // 2 as varchar) as step_id, case when role = 'system' then ' ' else text end as text from conversations),
far as (select *, coalesce(pos <= max(pos) over (partition by run_id order by idx rows between unbounded preceding and 1 preceding), false) as late, not regexp_matches(text, '\\S') as blank from ev),
steps as (select *, row_number() over (partition by run_id order by idx) - 1 as ordinal from far where not late and not blank),
{BAG},
f as (select s.run_id, idx, s.ordinal, step_id, drift_prev, drift_anchor, coalesce(drift_prev > 0.8011 or drift_anchor > 0.8011, false) as flagged from steps s join drift using (run_id, ordinal)),
g as (select *, flagged and row_number() over (partition by run_id, step_id, flagged order by idx) = 1 as fresh from f)
select e.run_id, e.idx, e.pos, e.step_id, ordinal, {_r6('drift_prev', 'drift_anchor')}, coalesce(flagged, false) as flagged, coalesce(fresh, false) as fresh,
  case when late then 'step ' || e.step_id || ' at position ' || e.pos || ' came late' when blank then 'step ' || e.step_id || ' skipped: empty or non-text content' else '' end as note
from far e left join g on g.run_id = e.run_id and g.idx = e.idx"""
    out |= _wider(sig, chosen, origin, matrix, cross, margin, consecutive, facts, held)
    return out


SQL = build()
