"""DuckDB oracle SQL for every registered query (tables are pre-registered views named after the parquet files).

Each entry re-states the query in SQL on the same driver tables; shared CTE builders keep the long synthesis
expressions in one place. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from seqlab.operators import corpus as X
from seqlab.operators import rules as R
from seqlab.operators import synth as S
from seqlab.operators.generation import STEPS, VARIANTS
from seqlab.plans import sqlkit as K

GEN = "gen"


def samples_cte() -> str:
    """samples(id, model, rule, variant, step, prompt, generated) from events."""
    ms = K.md5key("'sample'", "CAST(event_id AS VARCHAR)")
    steps = "[" + ", ".join(str(s) for s in STEPS) + "]"
    prompt = K.by_rule("rule", lambda r: K.pick(R.PROMPTS[r], f"pd % {len(R.PROMPTS[r])}"))
    mv = K.md5key(K.q(GEN), "rule", "'valid'", "CAST(id AS VARCHAR)")
    mi = K.md5key(K.q(GEN), "rule", "'invalid'", "CAST(id AS VARCHAR)")
    good = K.by_rule("rule", lambda r: K.valid_sql(r, "mv"))
    bad = K.by_rule("rule", lambda r: K.invalid_sql(r, "mi", "id")[1])
    untagged = ("CASE WHEN noise = 0 THEN body WHEN noise = 1 THEN concat_ws(' ', body, event_type) "
                "WHEN noise = 2 THEN concat_ws(chr(10), body, props) WHEN noise = 3 THEN body || '.' "
                "WHEN noise = 4 THEN concat_ws(' ', body, body) "
                "ELSE chr(12288) || body || chr(160) || event_type END")

    def tagged(r):
        o, c = (K.q(x) for x in R.EXTRACT_TAGS[r])
        return (f"CASE WHEN noise = 0 THEN concat_ws(' ', {o}, body, {c}) "
                f"WHEN noise = 1 THEN concat_ws(' ', {o}, body, {c}, event_type) "
                f"WHEN noise = 2 THEN {o} || ' ' || body || chr(10) || props "
                f"WHEN noise = 3 THEN {o} || ' ' || body || '. ' || {c} "
                f"WHEN noise = 4 THEN {o} || ' ' || body || ' ' || event_type || ' </x>' "
                f"ELSE body || chr(10) || event_type END")

    generated = K.by_rule("rule", lambda r: tagged(r) if r in R.EXTRACT_TAGS else untagged)
    return f"""
s0 AS (SELECT event_id AS id, event_type, props, {ms} AS ms FROM events),
s1 AS (SELECT id, event_type, props,
              {K.pick(R.RULES, K.u32('ms') + ' % 5')} AS rule,
              {K.nib('ms', 9)} % 4 AS vi, {K.nib('ms', 10)} % 4 AS si,
              {K.nib('ms', 11)} AS pd, {K.nib('ms', 12)} AS gd, {K.nib('ms', 13)} % 6 AS noise FROM s0),
s2 AS (SELECT *, {K.lst(VARIANTS)}[vi + 1] AS variant, {steps}[si + 1] AS step,
              {mv} AS mv, {mi} AS mi FROM s1),
s3 AS (SELECT *, {prompt} AS prompt, CASE WHEN gd < 4 + vi * 2 + si THEN {good} ELSE {bad} END AS body FROM s2),
samples AS (SELECT id, concat_ws('_', 'ngram', rule, variant, 'checkpoint-' || step) AS model, rule, variant,
                   step, prompt, {generated} AS generated FROM s3)"""


def verdicts_cte() -> str:
    ex = K.by_rule("rule", lambda r: K.extract_sql(r, "generated"))
    strict = K.by_rule("rule", lambda r: K.strict_sql(r, "t"))
    lenient = ("CASE WHEN rule = 'tivari' THEN " + K.lenient_sql("tivari", "tp") +
               " WHEN rule = 'grammar3' THEN " + K.lenient_sql("grammar3", "t") + " ELSE NULL END")
    return samples_cte() + f""",
v0 AS (SELECT *, {ex} AS extracted FROM samples),
v1 AS (SELECT *, {K.toks('extracted')} AS t FROM v0),
v2 AS (SELECT *, string_split({K.punct_strip_norm("array_to_string(t, ' ')")}, ' ') AS tp0 FROM v1),
v3 AS (SELECT *, list_filter(tp0, lambda x: x <> '') AS tp FROM v2),
verdicts AS (SELECT id, model, rule, variant, step, prompt, generated, extracted,
                    {strict} AS is_valid, {lenient} AS is_lenient_valid FROM v3)"""


def rate(num: str, den: str) -> str:
    return f"round(coalesce(CAST({num} AS DOUBLE) / nullif({den}, 0), 0.0), 6)"


def validity_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    return "WITH " + verdicts_cte() + f"""
SELECT {k}, CAST(count(*) AS BIGINT) AS total, CAST(count_if(is_valid) AS BIGINT) AS valid,
       CAST(count(*) - count_if(is_valid) AS BIGINT) AS invalid,
       {rate('count_if(is_valid)', 'count(*)')} AS validity_rate,
       CAST(count_if(coalesce(is_lenient_valid, false)) AS BIGINT) AS lenient_valid,
       {rate('count_if(coalesce(is_lenient_valid, false))', 'count(*)')} AS lenient_validity_rate
FROM verdicts GROUP BY {k}"""


RUN = "model, rule, variant, step"
ORACLE: dict[str, str] = {}


def with_v(body: str) -> str:
    return "WITH " + verdicts_cte() + "\n" + body


def skey(seed, rule, label="valid", idc="id") -> str:
    return K.md5key(K.q(str(seed)), K.q(rule) if not rule.startswith("@") else rule[1:], K.q(label),
                    f"CAST({idc} AS VARCHAR)")


def synth_valid_sql(rule: str, seed=42, src="SELECT event_id AS id FROM events") -> str:
    return f"SELECT id, {K.valid_sql(rule, 'm')} AS text FROM (SELECT id, {skey(seed, rule)} AS m FROM ({src}))"


def synth_invalid_sql(rule: str, seed=42) -> str:
    vt, text = K.invalid_sql(rule, "m", "id")
    return (f"SELECT id, {vt} AS violation, {text} AS text FROM "
            f"(SELECT event_id AS id, {skey(seed, rule, 'invalid', 'event_id')} AS m FROM events)")


def splits_cte() -> str:
    rows = ", ".join(f"({K.q(r)}, {K.q(sp)}, {sd}, {K.q(lb)})" for r, sp, sd, lb in S.split_combos())
    valid = K.by_rule("rule", lambda r: K.valid_sql(r, "mv"))
    inv = K.by_rule("rule", lambda r: K.invalid_sql(r, "mi", "id")[1])
    viol = K.by_rule("rule", lambda r: K.invalid_sql(r, "mi", "id")[0])
    mk = lambda lb: K.md5key("CAST(seed AS VARCHAR)", "rule", K.q(lb), "CAST(id AS VARCHAR)")
    return f"""combos(rule, split, seed, label) AS (VALUES {rows}),
sp0 AS (SELECT c.rule, c.split, c.seed, c.label, e.event_id AS id FROM combos c, events e),
sp1 AS (SELECT *, {mk('valid')} AS mv, {mk('invalid')} AS mi FROM sp0),
splits AS (SELECT rule, split, label, id, CASE WHEN label = 'invalid' THEN {viol} END AS violation,
                  CASE WHEN label = 'valid' THEN {valid} ELSE {inv} END AS text FROM sp1)"""


def n_cte() -> str:
    return "nn AS (SELECT count(*)::BIGINT AS n FROM events)"


def expl_pick_sql(rule: str, key: str) -> str:
    if rule in X.EXPLANATION_BLOCKS:
        return K.q(X.EXPLANATION_BLOCKS[rule])
    sents = X.EXPLANATION_SENTENCES[rule]
    m = K.md5key(K.q(f"expl:{rule}"), f"CAST({key} AS VARCHAR)")
    return K.pick(sents, f"{K.u32(m)} % {len(sents)}")


def wrap_sql(rule: str, t: str) -> str:
    tag = R.REGISTRY[rule].tag
    return f"concat_ws(' ', {K.q(tag[0])}, {t}, {K.q(tag[1])})" if tag else t


def interleave_sql(rule: str, ratio: float, mode: str = "docs") -> str:
    """SELECT rule, ratio, ord, doc_pos, kind, text for one interleaved corpus (ids from events)."""
    ex = synth_valid_sql(rule)
    r = f"{ratio!r}::DOUBLE"
    if ratio >= 1.0:
        return (f"SELECT {K.q(rule)} AS rule, {r} AS ratio, id * 2 AS ord, id AS doc_pos, 'explanation' AS kind, "
                f"{expl_pick_sql(rule, 'id')} AS text FROM ({ex})")
    lines = X.explanation_lines(rule)
    if mode == "docs":
        k = f"greatest(1, floor(n * {ratio!r} / (1 - {ratio!r})))::BIGINT"
    elif mode == "lines_a":
        k = f"greatest(1, floor((n + floor(n * {ratio!r} / (1 - {ratio!r}))) * {ratio!r} / {lines}))::BIGINT"
    else:
        k = f"greatest(1, floor(n * {ratio!r} / {lines}))::BIGINT"
    plan = (f"(SELECT k, every, least(k, (n - 1) // every) AS kk FROM "
            f"(SELECT n, k, greatest(1, n // (k + 1)) AS every FROM (SELECT n, {k} AS k FROM nn)))")
    return f"""SELECT {K.q(rule)} AS rule, {r} AS ratio, id * 2 + 1 AS ord,
       id + least(kk, id // every) AS doc_pos, 'example' AS kind, {wrap_sql(rule, 'text')} AS text
FROM ({ex}), {plan}
UNION ALL
SELECT {K.q(rule)} AS rule, {r} AS ratio, id * 2 AS ord, id + id // every - 1 AS doc_pos, 'explanation' AS kind,
       {expl_pick_sql(rule, 'id // every')} AS text
FROM ({ex}), {plan}
WHERE id > 0 AND id % every = 0 AND id // every <= kk"""


def _register():
    run = ["model", "rule", "variant", "step"]
    ORACLE["validity_overall"] = validity_sql(run)
    ORACLE["validity_by_prompt"] = validity_sql(run + ["prompt"])
    ORACLE["validity_lenient"] = with_v(f"""
SELECT {RUN}, count(*)::BIGINT AS total, count_if(coalesce(is_lenient_valid, false))::BIGINT AS lenient_valid,
       {rate('count_if(coalesce(is_lenient_valid, false))', 'count(*)')} AS lenient_validity_rate
FROM verdicts GROUP BY {RUN}""")
    ORACLE["validity_rollup"] = with_v(f"""
SELECT rule, variant, step, prompt, count(*)::BIGINT AS total, count_if(is_valid)::BIGINT AS valid,
       {rate('count_if(is_valid)', 'count(*)')} AS validity_rate,
       count_if(coalesce(is_lenient_valid, false))::BIGINT AS lenient_valid,
       {rate('count_if(coalesce(is_lenient_valid, false))', 'count(*)')} AS lenient_validity_rate
FROM verdicts GROUP BY ROLLUP (rule, variant, step, prompt)""")
    cls = ("CASE WHEN is_valid THEN 'valid' WHEN coalesce(is_lenient_valid, false) THEN 'lenient_only' "
           "ELSE 'invalid' END")
    ORACLE["examples_per_class"] = with_v(f"""
SELECT * FROM (SELECT {RUN}, class, (row_number() OVER (PARTITION BY {RUN}, class ORDER BY id))::INTEGER AS rn,
                      id, prompt, extracted FROM (SELECT *, {cls} AS class FROM verdicts)) WHERE rn <= 5""")
    ORACLE["lenient_only"] = with_v("""
SELECT id, rule, prompt, extracted FROM verdicts WHERE coalesce(is_lenient_valid, false) AND NOT is_valid""")
    viol = K.by_rule("rule", lambda r: K.violation_sql(r, "t"))
    ORACLE["violation_class"] = with_v(f"SELECT id, rule, {viol} AS violation FROM v3")
    ORACLE["violation_dist"] = with_v(f"""
SELECT rule, variant, violation, count(*)::BIGINT AS n
FROM (SELECT rule, variant, {viol} AS violation FROM v3) WHERE violation <> 'valid' GROUP BY ALL""")
    for name, rule in [("valid_run", "grammar1"), ("valid_pairs", "grammar2"), ("valid_palindrome", "grammar3"),
                       ("valid_run_b", "tivari"), ("valid_bounded", "tivari_b")]:
        ORACLE[name] = with_v(f"SELECT id, rule, {K.strict_sql(rule, 't')} AS ok FROM v3")
    ORACLE["lenient_run"] = with_v(f"SELECT id, rule, {K.lenient_sql('tivari', 't')} AS ok FROM v3")
    ORACLE["lenient_palindrome"] = with_v(f"SELECT id, rule, {K.lenient_sql('grammar3', 't')} AS ok FROM v3")
    ORACLE["tokenize_ws"] = (f"SELECT doc_id, len(t)::INTEGER AS n_tokens, array_to_string(t, ' ') AS tokens_joined "
                             f"FROM (SELECT doc_id, {K.toks('text')} AS t FROM documents)")
    for name, rule in [("synth_run", "grammar1"), ("synth_pairs", "grammar2"), ("synth_palindrome", "grammar3"),
                       ("synth_run_b", "tivari"), ("synth_bounded", "tivari_b")]:
        ORACLE[name] = synth_valid_sql(rule)
    for name, rule in [("synth_bad_run", "grammar1"), ("synth_bad_pairs", "grammar2"),
                       ("synth_bad_palindrome", "grammar3"), ("synth_bad_run_b", "tivari"),
                       ("synth_bad_bounded", "tivari_b")]:
        ORACLE[name] = synth_invalid_sql(rule)
    ORACLE["synth_splits"] = "WITH " + splits_cte() + "\nSELECT * FROM splits"
    ORACLE["wrap_doc"] = f"SELECT id, {wrap_sql('tivari', 'text')} AS doc FROM ({synth_valid_sql('tivari')})"
    o, c = R.TAGS["grammar3"]
    unwrapped = f"coalesce({K.tag_extract(wrap_sql('grammar3', 'text'), o, c, False)}, {wrap_sql('grammar3', 'text')})"
    ORACLE["unwrap_doc"] = (f"SELECT id, {unwrapped} AS unwrapped, {unwrapped} = text AS round_trip "
                            f"FROM ({synth_valid_sql('grammar3')})")
    strict_t = K.by_rule("rule", lambda r: K.strict_sql(r, "t"))
    ORACLE["verify_splits"] = "WITH " + splits_cte() + f"""
SELECT rule, split, label, count(*)::BIGINT AS n,
       count_if(({strict_t}) <> (label = 'valid'))::BIGINT AS n_errors
FROM (SELECT *, {K.toks('text')} AS t FROM splits) GROUP BY rule, split, label"""
    ORACLE["split_overlap"] = "WITH " + splits_cte() + """,
tr AS (SELECT DISTINCT rule, text FROM splits WHERE split = 'train' AND label = 'valid'),
te AS (SELECT DISTINCT rule, text FROM splits WHERE split = 'test' AND label = 'valid')
SELECT a.rule, a.n_train_distinct, b.n_test_distinct, coalesce(c.n_shared, 0)::BIGINT AS n_shared
FROM (SELECT rule, count(*)::BIGINT AS n_train_distinct FROM tr GROUP BY rule) a
JOIN (SELECT rule, count(*)::BIGINT AS n_test_distinct FROM te GROUP BY rule) b USING (rule)
LEFT JOIN (SELECT tr.rule, count(*)::BIGINT AS n_shared FROM tr JOIN te USING (rule, text) GROUP BY tr.rule) c
USING (rule)"""
    ORACLE["test_only"] = "WITH " + splits_cte() + """
SELECT rule, text FROM splits WHERE split = 'test' AND label = 'valid'
EXCEPT SELECT rule, text FROM splits WHERE split = 'train' AND label = 'valid'"""
    # extraction
    ORACLE["extract_to_end"] = "WITH " + samples_cte() + \
        f"\nSELECT id, {K.extract_sql('grammar1', 'generated')} AS extracted FROM samples"
    ORACLE["extract_pairs"] = "WITH " + samples_cte() + \
        f"\nSELECT id, {K.extract_sql('grammar2', 'generated')} AS extracted FROM samples"
    st = K.strip("html")
    ORACLE["extract_tag"] = (f"SELECT page_id, coalesce({K.tag_extract(st, '<title>', '</title>')}, "
                             f"{K.first_line(st)}) AS title FROM pages")
    ORACLE["first_line"] = f"SELECT doc_id, {K.first_line('text')} AS first_line FROM documents"
    ORACLE["normalize_punct"] = f"SELECT doc_id, {K.punct_strip_norm(K.norm('text'))} AS normalized FROM documents"
    ORACLE["strip_prompt"] = "WITH " + samples_cte() + f"""
SELECT id, {K.first_line("CASE WHEN starts_with(generated, prompt) THEN substr(generated, length(prompt) + 1) "
                         "ELSE generated END")} AS continuation FROM samples"""
    fused = K.by_rule("rule", lambda r: K.fused_sql("t", R.REGISTRY[r].rule_tokens))
    ORACLE["fused_tokens"] = "WITH " + samples_cte() + f"""
SELECT id, rule, ({fused})::INTEGER AS n_fused FROM (SELECT *, {K.toks('generated')} AS t FROM samples)"""
    rule_alt = "|".join(sorted(R.RULES, key=len, reverse=True))
    var_alt = "|".join(sorted(VARIANTS, key=len, reverse=True))
    pat = K.q(r"^(.+?)_(%s)_(%s)_checkpoint-(\d+)$" % (rule_alt, var_alt))
    ORACLE["parse_run_name"] = "WITH " + samples_cte() + f"""
SELECT model, regexp_extract(model, {pat}, 1) AS base, regexp_extract(model, {pat}, 2) AS rule,
       regexp_extract(model, {pat}, 3) AS variant, regexp_extract(model, {pat}, 4)::INTEGER AS step,
       coalesce(nullif(regexp_extract(model, '_explained_(\\d+)pct_', 1), '')::INTEGER, 0) AS pct
FROM (SELECT DISTINCT model FROM samples)"""
    # reports
    runs = f"""runs AS (SELECT {RUN}, count(*)::BIGINT AS total, count_if(is_valid)::BIGINT AS valid,
       {rate('count_if(is_valid)', 'count(*)')} AS validity_rate FROM verdicts GROUP BY {RUN})"""
    rvs = f"""rvs AS (SELECT rule, variant, step, count(*)::BIGINT AS total, count_if(is_valid)::BIGINT AS valid,
       {rate('count_if(is_valid)', 'count(*)')} AS validity_rate FROM verdicts GROUP BY rule, variant, step)"""
    ORACLE["leaderboard"] = "WITH " + verdicts_cte() + ",\n" + runs + """
SELECT model, validity_rate,
       (row_number() OVER (ORDER BY coalesce(validity_rate, 0) DESC, model))::INTEGER AS position FROM runs"""
    ORACLE["checkpoint_order"] = "WITH " + samples_cte() + """
SELECT checkpoint, step_num, (row_number() OVER (ORDER BY step_num, checkpoint))::INTEGER AS position
FROM (SELECT checkpoint, regexp_extract(checkpoint, '-(\\d+)$', 1)::INTEGER AS step_num
      FROM (SELECT DISTINCT 'checkpoint-' || step AS checkpoint FROM samples))"""
    piv = ", ".join(f"{rate(f'count_if(is_valid AND variant = {K.q(v)})', f'count_if(variant = {K.q(v)})')} "
                    f"AS {v}" for v in VARIANTS)
    piv_null = ", ".join(f"CASE WHEN count_if(variant = {K.q(v)}) > 0 THEN "
                         f"{rate(f'count_if(is_valid AND variant = {K.q(v)})', f'count_if(variant = {K.q(v)})')} "
                         f"END AS {v}" for v in VARIANTS)
    ORACLE["pivot_validity"] = with_v(f"SELECT rule, step, {piv_null} FROM verdicts GROUP BY rule, step")
    ORACLE["pivot_prompt"] = with_v(f"SELECT rule, prompt, {piv_null} FROM verdicts GROUP BY rule, prompt")
    base = """bj AS (SELECT v.*, b.valid AS base_valid, b.total AS base_total, b.validity_rate AS base_rate
FROM rvs v JOIN rvs b ON v.rule = b.rule AND v.step = b.step AND b.variant = 'examples'
WHERE v.variant <> 'examples')"""
    z = ("CASE WHEN se > 0 THEN (p1 - p2) / se END")
    a = ", ".join(str(x) for x in [])
    from seqlab.functions.stats import AS_A, AS_P
    t = f"(1.0 / (1.0 + {AS_P!r} * abs(z) / sqrt(2.0)))"
    poly = "0.0"
    for c_ in reversed(AS_A):
        poly = f"(({poly}) + {c_!r}) * {t}"
    pval = f"({poly}) * exp(-(abs(z) / sqrt(2.0)) * (abs(z) / sqrt(2.0)))"
    ORACLE["z_test"] = "WITH " + verdicts_cte() + ",\n" + rvs + ",\n" + base + f""",
zz AS (SELECT *, {z} AS z FROM (SELECT *, valid / total AS p1, base_valid / base_total AS p2,
        sqrt(((valid + base_valid) / (total + base_total)) * (1 - (valid + base_valid) / (total + base_total))
             * (1.0 / total + 1.0 / base_total)) AS se FROM bj)),
zp AS (SELECT *, {pval} AS p FROM zz)
SELECT rule, step, variant, valid, total, base_valid, base_total, round(z, 6) AS z, round(p, 6) AS p_value,
       CASE WHEN z IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*'
            ELSE '' END AS stars FROM zp"""
    ORACLE["pp_delta"] = "WITH " + verdicts_cte() + ",\n" + rvs + ",\n" + base + """
SELECT rule, step, variant, validity_rate, base_rate, round((validity_rate - base_rate) * 100.0, 6) AS delta_pp,
       round((validity_rate - base_rate) / nullif(base_rate, 0), 6) AS rel_improvement FROM bj"""
    ORACLE["best_variant"] = "WITH " + verdicts_cte() + ",\n" + rvs + """
SELECT rule, step, variant, validity_rate FROM (
  SELECT *, rank() OVER (PARTITION BY rule, step ORDER BY validity_rate DESC) AS rk FROM rvs) WHERE rk = 1"""
    ORACLE["checkpoint_trend"] = "WITH " + verdicts_cte() + ",\n" + rvs + """
SELECT rule, variant, step, validity_rate, prev_rate, round(validity_rate - prev_rate, 6) AS delta,
       peak_step, round(last_rate - peak_rate, 6) AS final_minus_peak
FROM (SELECT *, lag(validity_rate) OVER (PARTITION BY rule, variant ORDER BY step) AS prev_rate,
             first_value(step) OVER (PARTITION BY rule, variant ORDER BY validity_rate DESC, step
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS peak_step,
             max(validity_rate) OVER (PARTITION BY rule, variant) AS peak_rate,
             last_value(validity_rate) OVER (PARTITION BY rule, variant ORDER BY step
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_rate
      FROM rvs)"""
    vdim = ", ".join(f"({K.q(v)}, {i})" for i, v in enumerate(VARIANTS))
    ORACLE["variant_metrics"] = with_v(f"""
SELECT p.rule, d.variant, d.ord, p.total, p.validity_rate
FROM (VALUES {vdim}) d(variant, ord)
LEFT JOIN (SELECT rule, variant, count(*)::BIGINT AS total, {rate('count_if(is_valid)', 'count(*)')} AS validity_rate
           FROM verdicts GROUP BY rule, variant) p ON p.variant = d.variant""")
    # corpus
    ORACLE["corpus_examples"] = " UNION ALL ".join(
        f"SELECT {K.q(r)} AS rule, id AS doc_pos, {wrap_sql(r, 'text')} AS text FROM ({synth_valid_sql(r)})"
        for r in R.RULES)
    ORACLE["interleave_docs"] = "WITH " + n_cte() + "\n" + " UNION ALL ".join(
        f"({interleave_sql(r, 0.05)})" for r in R.RULES)
    ORACLE["interleave_all"] = "WITH " + n_cte() + "\n" + interleave_sql("tivari", 1.0)
    ORACLE["interleave_lines_a"] = "WITH " + n_cte() + "\n" + interleave_sql("grammar1", 0.05, "lines_a")
    ORACLE["interleave_lines_b"] = "WITH " + n_cte() + "\n" + interleave_sql("grammar2", 0.05, "lines_b")
    parts = " UNION ALL ".join(f"(SELECT rule, ratio, kind FROM ({interleave_sql(r, x)}))"
                               for r in R.RULES for x in X.EXPLANATION_RATIOS)
    ORACLE["mix_audit"] = "WITH " + n_cte() + f"""
SELECT rule, ratio, count(*)::BIGINT AS n_docs, count_if(kind = 'explanation')::BIGINT AS n_explanations,
       round(count_if(kind = 'explanation') / count(*), 6) AS achieved_ratio FROM ({parts}) GROUP BY rule, ratio"""
    p = X.MIX_PROBABILITY
    u = f"(({K.u32(K.md5key(K.q('mix:42'), 'CAST(doc_id AS VARCHAR)'))} + 0.5) / 4294967296.0)"
    ORACLE["mix_ratio"] = "WITH " + n_cte() + f""",
syn AS ({interleave_sql('tivari', 0.05)}),
nsyn AS (SELECT count(*)::BIGINT AS ns FROM syn),
c AS (SELECT doc_id AS canon_pos, text, floor(ln({u}) / ln({p!r}))::BIGINT AS g FROM documents),
cum AS (SELECT *, coalesce(sum(g) OVER (ORDER BY canon_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  ::BIGINT AS cum_before FROM c),
dr AS (SELECT canon_pos, unnest(range(0, g)) AS slot, cum_before FROM cum WHERE g > 0)
SELECT canon_pos, g AS slot, 'canonical' AS source, NULL::BIGINT AS syn_pos, text FROM cum
UNION ALL
SELECT dr.canon_pos, dr.slot, 'synthetic' AS source, (dr.cum_before + dr.slot) % nsyn.ns AS syn_pos, syn.text
FROM dr, nsyn JOIN syn ON syn.doc_pos = (dr.cum_before + dr.slot) % nsyn.ns"""
    ORACLE["shuffle_seeded"] = (f"SELECT doc_id, {K.md5key(K.q('shuffle:42'), 'CAST(doc_id AS VARCHAR)')} "
                                f"AS shuffle_key FROM documents")
    ORACLE["truncate_tokens"] = (f"SELECT doc_id, len(t)::INTEGER AS n_tokens, "
                                 f"array_to_string(list_slice(t, 1, {X.MAX_SEQ_TOKENS}), ' ') AS truncated "
                                 f"FROM (SELECT doc_id, {K.toks('text')} AS t FROM documents)")
    ORACLE["token_budget"] = f"""
SELECT source, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS raw_tokens,
       sum(least(n, {X.MAX_SEQ_TOKENS}))::BIGINT AS budget_tokens
FROM (SELECT source, len({K.toks('text')}) AS n FROM documents) GROUP BY source"""
    ORACLE["corpus_stats"] = ("SELECT source, count(*)::BIGINT AS n_docs, sum(strlen(text))::BIGINT AS n_bytes "
                              "FROM documents GROUP BY source")
    ORACLE["load_lines"] = f"""
SELECT doc_id, line_no, line FROM (
  SELECT doc_id, line_no, {K.strip('raw')} AS line FROM (
    SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INTEGER AS line_no, unnest(parts) AS raw
    FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS parts FROM documents)))
WHERE line <> ''"""


_register()


# ---- n-gram scorer ----------------------------------------------------------------------------------------------

def corpora_sql() -> str:
    from seqlab.operators.generation import VARIANT_RATIOS
    parts = []
    for r in R.RULES:
        for v in VARIANTS:
            ratio = VARIANT_RATIOS[v]
            if ratio == 0.0:
                src = f"SELECT {wrap_sql(r, 'text')} AS text FROM ({synth_valid_sql(r)})"
            else:
                src = f"SELECT text FROM ({interleave_sql(r, ratio)})"
            parts.append(f"SELECT {K.q(r)} AS rule, {K.q(v)} AS variant, text FROM ({src})")
    return " UNION ALL ".join(parts)


def pairs_sql(src: str, keys: str) -> str:
    """(keys, pos, prev, next) from a relation with a ``text`` column."""
    return f"""SELECT {keys}, (i - 1)::INTEGER AS pos, t[i] AS prev, t[i + 1] AS next
FROM (SELECT {keys}, t, unnest(generate_series(1, len(t) - 1)) AS i
      FROM (SELECT {keys}, {K.toks('text')} AS t FROM ({src})))"""


def tests_values() -> str:
    """(rule, test, kind, prefix, token, side, threshold), the prefix as a list of tokens."""
    from seqlab.operators.ngram import DECISION_TESTS
    rows = []
    for rule, tests in DECISION_TESTS.items():
        for name, kind, prefix, good, bad, thr in tests:
            pre = "[" + ", ".join(K.q(x) for x in prefix.split()) + "]"
            th = "NULL::DOUBLE" if thr is None else f"{thr!r}::DOUBLE"
            rows += [f"({K.q(rule)}, {K.q(name)}, {K.q(kind)}, {pre}, {K.q(t)}, {K.q(side)}, {th})"
                     for side, some in (("good", good), ("bad", bad)) for t in some]
    return "tests(rule, test, kind, prefix, token, side, threshold) AS (VALUES " + ", ".join(rows) + ")"


def model_ctes() -> str:
    """Places are found by comparing slices of the tokens with every end of a test's prefix; the longest end that a model
    has seen with a token after it decides."""
    return f"""{n_cte()},
corp AS ({corpora_sql()}),
cnt AS (SELECT rule, variant, prev, next, count(*)::BIGINT AS n FROM ({pairs_sql('corp', 'rule, variant')})
        GROUP BY ALL),
tot AS (SELECT rule, variant, prev, sum(n) AS ctx_n FROM cnt GROUP BY ALL),
{tests_values()},
ends AS (SELECT DISTINCT rule, k, prefix[len(prefix) - k + 1:len(prefix)] AS ctx
         FROM (SELECT rule, prefix, unnest(generate_series(1, len(prefix))) AS k FROM tests)),
sents AS (SELECT rule, variant, text, count(*) AS times FROM corp GROUP BY ALL),
spots AS (SELECT rule, variant, times, t, unnest(generate_series(1, len(t) - 1)) AS i
          FROM (SELECT rule, variant, times, {K.toks('text')} AS t FROM sents)),
after AS (SELECT e.rule, s.variant, e.ctx, s.t[s.i + 1] AS token, sum(s.times) AS n
          FROM ends e JOIN spots s ON s.rule = e.rule AND s.t[s.i] = e.ctx[e.k] AND s.i >= e.k
          AND s.t[s.i - e.k + 1:s.i] = e.ctx GROUP BY ALL),
heard AS (SELECT rule, variant, ctx, sum(n) AS n FROM after GROUP BY ALL),
best AS (SELECT t.rule, t.prefix, h.variant, arg_max(h.ctx, len(h.ctx)) AS ctx, arg_max(h.n, len(h.ctx)) AS n
         FROM (SELECT DISTINCT rule, prefix FROM tests) t
         JOIN heard h ON h.rule = t.rule AND h.ctx = t.prefix[len(t.prefix) - len(h.ctx) + 1:len(t.prefix)]
         GROUP BY ALL),
probs AS (SELECT m.rule, m.variant, t.test, t.kind, t.token, t.side, t.threshold, coalesce(a.n / b.n, 0.0) AS prob
          FROM (SELECT DISTINCT rule, variant FROM cnt) m JOIN tests t ON t.rule = m.rule
          LEFT JOIN best b ON b.rule = m.rule AND b.variant = m.variant AND b.prefix = t.prefix
          LEFT JOIN after a ON a.rule = m.rule AND a.variant = m.variant AND a.ctx = b.ctx AND a.token = t.token),
dec AS (SELECT rule, variant, test, kind, sum(CASE WHEN side = 'good' THEN prob ELSE 0.0 END) AS gp,
               sum(CASE WHEN side = 'bad' THEN prob ELSE 0.0 END) AS bp, max(threshold) AS th,
               coalesce(max(CASE WHEN side = 'bad' THEN prob END), 0.0) AS worst
        FROM probs GROUP BY rule, variant, test, kind),
decr AS (SELECT rule, variant, test, kind, round(gp, 6) AS good_prob, round(bp, 6) AS bad_prob,
                CASE WHEN kind = 'mass' THEN gp > th WHEN kind = 'each' THEN gp > worst ELSE gp > bp END AS correct FROM dec),
acc AS (SELECT rule, variant, count_if(correct)::BIGINT AS n_correct, count(*)::BIGINT AS n_total,
               round(count_if(correct) / count(*), 6) AS accuracy FROM decr GROUP BY rule, variant)"""


def eval_sql() -> str:
    parts = []
    for r in R.RULES:
        parts.append(f"SELECT {K.q(r)} AS rule, 'valid' AS label, id, text FROM ({synth_valid_sql(r, 456)})")
        vt, text = K.invalid_sql(r, "m", "id")
        parts.append(f"SELECT {K.q(r)} AS rule, 'invalid' AS label, id, {text} AS text FROM "
                     f"(SELECT event_id AS id, {skey(456, r, 'invalid', 'event_id')} AS m FROM events)")
    variants = ", ".join(f"({K.q(v)})" for v in VARIANTS)
    return f"SELECT e.rule, v.variant, e.label, e.id, e.text FROM ({' UNION ALL '.join(parts)}) e, " \
           f"(VALUES {variants}) v(variant)"


def loss_ctes() -> str:
    from seqlab.operators.ngram import SMOOTHING_ALPHA as A
    return model_ctes() + f""",
vocab AS (SELECT rule, variant, count(DISTINCT tok)::BIGINT AS vocab
          FROM (SELECT rule, variant, unnest({K.toks('text')}) AS tok FROM corp) GROUP BY ALL),
ev AS ({eval_sql()}),
lp AS (SELECT p.*, -ln((coalesce(c.n, 0) + {A!r}) / (coalesce(tot.ctx_n, 0) + {A!r} * vb.vocab)) AS loss
       FROM ({pairs_sql('ev', 'rule, variant, label, id')}) p
       LEFT JOIN cnt c ON c.rule = p.rule AND c.variant = p.variant AND c.prev = p.prev AND c.next = p.next
       LEFT JOIN tot ON tot.rule = p.rule AND tot.variant = p.variant AND tot.prev = p.prev
       LEFT JOIN vocab vb ON vb.rule = p.rule AND vb.variant = p.variant),
pt AS (SELECT rule, variant, label, id, sum(loss) AS ls, count(*)::BIGINT AS n_tokens,
              exp(sum(loss) / count(*)) AS ppl FROM lp GROUP BY rule, variant, label, id),
ns AS (SELECT rule, variant, label, count(*)::BIGINT AS n_samples FROM ev GROUP BY ALL),
pc AS (SELECT ns.rule, ns.variant, ns.label, round(exp(g.ls / g.nt), 6) AS perplexity,
              round(g.ls / g.nt, 6) AS mean_loss, round(g.mp, 6) AS mean_per_text_ppl,
              round(CASE WHEN g.k > 1 THEN g.sd ELSE 0.0 END, 6) AS std_per_text_ppl,
              coalesce(g.nt, 0)::BIGINT AS total_tokens, ns.n_samples
       FROM ns LEFT JOIN (SELECT rule, variant, label, sum(ls) AS ls, sum(n_tokens) AS nt, avg(ppl) AS mp,
                                 stddev_pop(ppl) AS sd, count(*) AS k FROM pt GROUP BY ALL) g
       ON g.rule = ns.rule AND g.variant = ns.variant AND g.label = ns.label),
gap AS (SELECT rule, variant, max(CASE WHEN label = 'valid' THEN perplexity END) AS valid_ppl,
               max(CASE WHEN label = 'invalid' THEN perplexity END) AS invalid_ppl FROM pc GROUP BY rule, variant),
gapr AS (SELECT rule, variant, valid_ppl, invalid_ppl, round(invalid_ppl - valid_ppl, 6) AS perplexity_gap,
                round(invalid_ppl / nullif(valid_ppl, 0), 6) AS perplexity_ratio FROM gap)"""


def _register_ngram():
    mix = ORACLE["mix_ratio"]
    ORACLE["ngram_counts"] = (f"SELECT prev, next, count(*)::BIGINT AS n FROM "
                              f"({pairs_sql('(' + mix + ')', 'canon_pos, slot')}) GROUP BY prev, next")
    ORACLE["next_token_prob"] = "WITH " + model_ctes() + \
        "\nSELECT rule, variant, test, token, side, round(prob, 6) AS prob FROM probs"
    ORACLE["decision_tests"] = "WITH " + model_ctes() + "\nSELECT * FROM decr"
    ORACLE["completion_accuracy"] = "WITH " + model_ctes() + "\nSELECT * FROM acc"
    ORACLE["token_loss"] = "WITH " + loss_ctes() + \
        "\nSELECT rule, variant, label, id, pos, prev, next, round(loss, 6) AS loss FROM lp"
    ORACLE["ppl_per_text"] = "WITH " + loss_ctes() + \
        "\nSELECT rule, variant, label, id, n_tokens, round(ppl, 6) AS ppl FROM pt"
    ORACLE["ppl_corpus"] = "WITH " + loss_ctes() + "\nSELECT * FROM pc"
    ORACLE["ppl_gap"] = "WITH " + loss_ctes() + "\nSELECT * FROM gapr"
    ORACLE["merge_metrics"] = "WITH " + loss_ctes() + ",\n" + verdicts_cte() + f""",
gen AS (SELECT rule, variant, {rate('count_if(is_valid)', 'count(*)')} AS validity_rate FROM verdicts
        GROUP BY rule, variant)
SELECT coalesce(gen.rule, gapr.rule, acc.rule) AS rule, coalesce(gen.variant, gapr.variant, acc.variant) AS variant,
       gen.validity_rate, gapr.valid_ppl, gapr.invalid_ppl, gapr.perplexity_gap, gapr.perplexity_ratio,
       acc.accuracy AS completion_accuracy
FROM gen FULL JOIN gapr ON gen.rule = gapr.rule AND gen.variant = gapr.variant
FULL JOIN acc ON coalesce(gen.rule, gapr.rule) = acc.rule AND coalesce(gen.variant, gapr.variant) = acc.variant"""
    prompts = ", ".join(f"({K.q(r)}, {K.q(p)})" for r in R.RULES for p in R.PROMPTS[r])
    ORACLE["prompt_fanout"] = (f"SELECT p.rule, p.prompt, e.event_id AS id FROM events e, "
                               f"(VALUES {prompts}) p(rule, prompt)")


_register_ngram()


def _register_sources():
    ORACLE["conv_alternation"] = """
SELECT conv_id, n_turns, has_system, n_bad, gapless,
       gapless AND n_bad = 0 AND body >= 2 AND body % 2 = 0 AS valid
FROM (SELECT conv_id, n_turns, first_role = 'system' AS has_system,
             (CASE WHEN first_role = 'system' THEN bad1 ELSE bad0 END)::INTEGER AS n_bad,
             mn = 0 AND mx = n_turns - 1 AND turns = n_turns AS gapless,
             CASE WHEN first_role = 'system' THEN n_turns - 1 ELSE n_turns END AS body
      FROM (SELECT conv_id, count(*)::BIGINT AS n_turns, min(turn) AS mn, max(turn) AS mx, count(DISTINCT turn) AS turns,
                   arg_min(role, turn) AS first_role,
                   count_if(role <> CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END) AS bad0,
                   count_if(turn > 0 AND role <> CASE WHEN (turn - 1) % 2 = 0 THEN 'user' ELSE 'assistant' END)
                     AS bad1
            FROM conversations GROUP BY conv_id))"""
    ORACLE["event_path_valid"] = """
SELECT user_id, n_events, first_type, last_type,
       n_events >= 3 AND first_type = 'signup' AND last_type = 'purchase' AND n_open = 1 AND n_close = 1
       AND n_other = 0 AS valid
FROM (SELECT user_id, count(*)::BIGINT AS n_events, first(event_type ORDER BY ts, event_id) AS first_type,
             last(event_type ORDER BY ts, event_id) AS last_type, count_if(event_type = 'signup') AS n_open,
             count_if(event_type = 'purchase') AS n_close,
             count_if(event_type NOT IN ('signup', 'purchase', 'view', 'click')) AS n_other
      FROM events GROUP BY user_id)"""
    ORACLE["scan_jsonl"] = "SELECT doc_id, text FROM documents"
    ORACLE["result_examples"] = ORACLE["examples_per_class"]
    ORACLE["results_scan"] = with_v(f"""
SELECT model, rule, count(*)::BIGINT AS total, count_if(is_valid)::BIGINT AS valid,
       {rate('count_if(is_valid)', 'count(*)')} AS validity_rate FROM verdicts GROUP BY model, rule""")
    ORACLE["report_explode"] = with_v(f"""
SELECT rule AS grammar, model, {rate('count_if(is_valid)', 'count(*)')} AS validity_rate,
       count_if(is_valid)::BIGINT AS valid, count(*)::BIGINT AS total FROM verdicts GROUP BY rule, model""")


_register_sources()


def _register_streams():
    ORACLE["stream_tokenize"] = ORACLE["tokenize_ws"]
    ORACLE["stream_validity"] = ORACLE["validity_overall"]
    ORACLE["stream_validity_prompt"] = ORACLE["validity_by_prompt"]
    ORACLE["stream_mix_cyclic"] = ORACLE["mix_ratio"]
    key = K.md5key(K.q("window:42"), "CAST(doc_id AS VARCHAR)")
    placed = f"(SELECT doc_id, {key} AS shuffle_key, doc_id + {K.u32(key)} % {X.SHUFFLE_BUFFER} AS shuffle_at FROM documents)"
    ORACLE["shuffle_buffered"] = f"SELECT doc_id, row_number() OVER (ORDER BY shuffle_at, shuffle_key) - 1 AS shuffled_pos FROM {placed}"
    ORACLE["stream_shuffle"] = f"SELECT *, shuffle_at // {X.SHUFFLE_BUFFER} AS bucket FROM {placed}"
    p = X.MIX_PROBABILITY
    u = f"(({K.u32(K.md5key(K.q('mix:42'), 'CAST(doc_id AS VARCHAR)'))} + 0.5) / 4294967296.0)"
    pk = K.u32(K.md5key("'pick'", "concat_ws(':', CAST(canon_pos AS VARCHAR), CAST(slot AS VARCHAR))"))
    ORACLE["stream_mix"] = "WITH " + n_cte() + f""",
syn AS ({interleave_sql('tivari', 0.05)}),
nsyn AS (SELECT count(*)::BIGINT AS ns FROM syn),
c AS (SELECT doc_id AS canon_pos, text, floor(ln({u}) / ln({p!r}))::BIGINT AS g FROM documents),
dr AS (SELECT canon_pos, unnest(range(0, g)) AS slot FROM c WHERE g > 0),
drp AS (SELECT canon_pos, slot, {pk} % nsyn.ns AS syn_pos FROM dr, nsyn)
SELECT canon_pos, g AS slot, 'canonical' AS source, NULL::BIGINT AS syn_pos, text FROM c
UNION ALL
SELECT drp.canon_pos, drp.slot, 'synthetic' AS source, drp.syn_pos, syn.text FROM drp JOIN syn ON syn.doc_pos = drp.syn_pos"""


_register_streams()


# ---- rules over ordered rows --------------------------------------------------------------------------------------

#: Rule: what a sentence looks like, and what the beginnings of sentences look like, as patterns over joined tokens. Written
#: out by hand, without the automata; a prefix check looks at the tokens up to the first closing one.
ROW_PATTERNS = {
    "rows_run": ("signup( (view|click))+ purchase", "signup( (view|click))*|signup( (view|click))+ purchase"),
    "rows_pairs": ("(view (click|purchase)|click (view|error))( (view (click|purchase)|click (view|error))){0,3}",
                   "((view (click|purchase)|click (view|error)) ){0,3}(view|click|view (click|purchase)|click (view|error))"),
    "rows_run_b": ("view( click)+ purchase", "view( click)*|view( click)+ purchase"),
    "rows_bounded": ("view( (click|error)){1,4} purchase", "view( (click|error)){0,4}|view( (click|error)){1,4} purchase"),
    "rows_palindrome": ("signup( (view|click|error))* purchase", "signup( (view|click|error))*( purchase)?"),
    "rows_lenient_run": ("view( click)+ purchase", "view( click)*|view( click)+ purchase"),
    "rows_lenient_palindrome": ("signup( (view|click|error))* purchase", "signup( (view|click|error))*( purchase)?"),
    "turns_run": ("user( assistant)+ user", "user( assistant)*|user( assistant)+ user"),
    "turns_pairs": ("user assistant( user assistant){0,3}", "(user assistant ){0,3}user( assistant)?"),
    "turns_alternating": ("user assistant( user assistant)*", "(user assistant )*user( assistant)?"),
    "turns_bounded": ("system( user){1,4} assistant", "system( user){0,4}|system( user){1,4} assistant"),
}


def row_rule_sql(name: str) -> str:
    whole, beginning = ROW_PATTERNS[name]
    keys, src = (("user_id, day", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(event_type ORDER BY ts, event_id) AS t "
                                  "FROM events GROUP BY ALL")
                 if name.startswith("rows") else ("conv_id", "SELECT conv_id, list(role ORDER BY turn, role) AS t FROM conversations GROUP BY ALL"))
    cut = "CASE WHEN list_contains(t, 'purchase') THEN t[1:list_position(t, 'purchase')] ELSE t END" if "lenient" in name else "t"
    inner = "u[2:len(u) - 1]"
    more = "" if "palindrome" not in name else f"""
  AND {inner} = list_reverse({inner}) AND len(list_filter({inner}, lambda x: x = 'click')) % 2 = 0
  AND len(list_filter({inner}, lambda x: x = 'error')) % 2 = 0"""
    return f"""
WITH s AS ({src}),
c AS (SELECT *, {cut} AS u FROM s),
b AS (SELECT {keys}, min(k) - 1 AS lost FROM (SELECT {keys}, u, unnest(generate_series(1, len(u))) AS k FROM c)
      WHERE NOT regexp_full_match(array_to_string(u[1:k], ' '), '{beginning}') GROUP BY ALL)
SELECT {keys}, len(t)::BIGINT AS n, lost::BIGINT AS lost, regexp_full_match(array_to_string(u, ' '), '{whole}'){more} AS valid
FROM c LEFT JOIN b USING ({keys})"""


ORACLE.update({_name: row_rule_sql(_name) for _name in ROW_PATTERNS})


# ---- the model of order n on documents ---------------------------------------------------------------------------

def order_n_ctes() -> str:
    """Counts per order in tables of their own, over lists of tokens; sc: every held-out place with its two contexts."""
    return f"""WITH d AS (SELECT doc_id, lang, {K.toks("coalesce(text, '')")} AS t,
    {K.u32(K.md5key(K.q('held-out'), 'CAST(doc_id AS VARCHAR)'))} % 10 = 0 AS held FROM documents),
tr AS (SELECT lang, i, t[i] AS w, CASE WHEN i > 1 THEN t[i - 1] END AS b, CASE WHEN i > 2 THEN t[i - 2] END AS a
       FROM (SELECT lang, t, unnest(generate_series(1, len(t))) AS i FROM d WHERE NOT held)),
n1 AS (SELECT lang, w, count(*) AS n FROM tr GROUP BY ALL),
n2 AS (SELECT lang, b, w, count(*) AS n FROM tr WHERE b IS NOT NULL GROUP BY ALL),
n3 AS (SELECT lang, a, b, w, count(*) AS n FROM tr WHERE a IS NOT NULL GROUP BY ALL),
t1 AS (SELECT lang, sum(n) AS s, count(*) AS v FROM n1 GROUP BY ALL),
t2 AS (SELECT lang, b, sum(n) AS s, count(*) AS v FROM n2 GROUP BY ALL),
t3 AS (SELECT lang, a, b, sum(n) AS s, count(*) AS v FROM n3 GROUP BY ALL),
sc AS (SELECT doc_id, lang, t[i] AS w, t[i - 1] AS b, CASE WHEN i > 2 THEN t[i - 2] END AS a
       FROM (SELECT doc_id, lang, t, unnest(generate_series(2, len(t))) AS i FROM d WHERE held)),
ask AS (SELECT DISTINCT lang, a, b, w FROM sc)"""


def order_n_p(ask: str) -> str:
    """SELECT ask.*, p for a relation ask(lang, a, b, w)."""
    from seqlab.operators.order_n import ALPHA as A
    p1 = f"(coalesce(n1.n, 0) + {A!r}::DOUBLE) / (t1.s + {A!r}::DOUBLE * (t1.v + 1))"
    p2 = f"CASE WHEN t2.s IS NULL THEN {p1} ELSE (coalesce(n2.n, 0) + t2.v * ({p1})) / (t2.s + t2.v) END"
    p3 = f"CASE WHEN t3.s IS NULL THEN {p2} ELSE (coalesce(n3.n, 0) + t3.v * ({p2})) / (t3.s + t3.v) END"
    return f"""SELECT q.*, {p3} AS p FROM ({ask}) q JOIN t1 ON t1.lang IS NOT DISTINCT FROM q.lang
LEFT JOIN n1 ON n1.lang IS NOT DISTINCT FROM q.lang AND n1.w = q.w
LEFT JOIN n2 ON n2.lang IS NOT DISTINCT FROM q.lang AND n2.b = q.b AND n2.w = q.w
LEFT JOIN t2 ON t2.lang IS NOT DISTINCT FROM q.lang AND t2.b = q.b
LEFT JOIN n3 ON n3.lang IS NOT DISTINCT FROM q.lang AND n3.a = q.a AND n3.b = q.b AND n3.w = q.w
LEFT JOIN t3 ON t3.lang IS NOT DISTINCT FROM q.lang AND t3.a = q.a AND t3.b = q.b"""


def _register_order_n():
    same = " AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in ("lang", "a", "b", "w"))
    texts = f"""{order_n_ctes()},
pr AS ({order_n_p('SELECT * FROM ask')}),
pt AS (SELECT x.lang, x.doc_id, sum(-ln(y.p)) AS loss, count(*)::BIGINT AS n_tokens FROM sc x JOIN pr y ON {same} GROUP BY ALL)"""
    ORACLE["docs_ppl_text"] = texts + """
SELECT lang, doc_id, round(loss, 6) AS loss, n_tokens, round(exp(loss / n_tokens), 6) AS ppl FROM pt"""
    ORACLE["docs_ppl"] = texts + """,
ns AS (SELECT lang, count(*)::BIGINT AS n_samples FROM d WHERE held GROUP BY lang)
SELECT ns.lang, round(exp(sum(loss) / sum(n_tokens)), 6) AS perplexity, round(sum(loss) / sum(n_tokens), 6) AS mean_loss,
  round(avg(exp(loss / n_tokens)), 6) AS mean_per_text_ppl,
  round(CASE WHEN count(*) > 1 THEN stddev_pop(exp(loss / n_tokens)) ELSE 0 END, 6) AS std_per_text_ppl,
  sum(n_tokens)::BIGINT AS total_tokens, any_value(n_samples) AS n_samples
FROM ns JOIN pt ON pt.lang IS NOT DISTINCT FROM ns.lang GROUP BY ns.lang"""
    parts = [f"SELECT lang, {k}::INTEGER AS k, sum(n)::BIGINT AS n_tokens, count(*)::BIGINT AS n_sequences, "
             f"count(DISTINCT {ctx})::BIGINT AS n_contexts, count_if(n = 1)::BIGINT AS n_once FROM n{k} GROUP BY lang"
             for k, ctx in ((1, "1"), (2, "b"), (3, "struct_pack(a := a, b := b)"))]
    ORACLE["docs_model"] = order_n_ctes() + "\n" + " UNION ALL ".join(parts)
    ORACLE["docs_completion"] = f"""{order_n_ctes()},
rv AS (SELECT lang, w AS rival FROM n1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(w) DESC) = 1),
pl AS (SELECT sc.*, rival FROM sc JOIN rv ON rv.lang IS NOT DISTINCT FROM sc.lang WHERE w <> rival),
pa AS ({order_n_p('SELECT DISTINCT lang, a, b, w FROM pl')}),
pb AS ({order_n_p('SELECT DISTINCT lang, a, b, rival AS w FROM pl')})
SELECT x.lang, x.rival, count_if(y.p > z.p)::BIGINT AS n_correct, count(*)::BIGINT AS n_total, round(count_if(y.p > z.p) / count(*), 6) AS accuracy
FROM pl x JOIN pa y ON {same} JOIN pb z ON {same.replace('y.', 'z.').replace('x.w', 'x.rival')} GROUP BY ALL"""
    ORACLE["docs_next_token"] = f"""{order_n_ctes()},
la AS (SELECT doc_id, lang, t[len(t)] AS w, t[len(t) - 1] AS b, CASE WHEN len(t) > 2 THEN t[len(t) - 2] END AS a FROM d WHERE held AND len(t) > 1)
SELECT lang, doc_id, w AS token, round(-ln(p), 6) AS loss FROM ({order_n_p('SELECT * FROM la')})"""


_register_order_n()
