"""DuckDB twins of the registered queries (the correctness oracle).

The SQL rebuilds the FIXTURES.md section 3 fixtures from the pre-registered
driver views and computes each result independently of the Spark code. Double
literals are written as ``0.5e0`` (a plain ``0.5`` is a decimal in DuckDB).
"""

from __future__ import annotations

from ..functions.text import EMOJI_PATTERN
from ..schema import DEFAULT_LABELS as L
from ..sources.fixtures import TRUTH_RULES

N = L.names


def _truth_cols(prefix: str = "true_") -> str:
    return ",\n  ".join(
        f"CASE WHEN doc_id % {m} < {c} THEN 1 ELSE 0 END AS {prefix}{n}"
        for n, (m, c) in TRUTH_RULES.items())


def _prob_cols() -> str:
    out = []
    for i, n in enumerate(N):
        base = (f"(CASE WHEN true_{n} = 1 THEN 0.51e0 + CAST(doc_id % 49 AS DOUBLE)/100 "
                f"ELSE CAST(doc_id % 51 AS DOUBLE)/100 END)")
        out.append(f"CASE WHEN (doc_id*31 + {i}) % 19 = 0 THEN 1 - {base} ELSE {base} END AS prob_{n}")
    return ",\n  ".join(out)


SCORED_CTE = f"""
truth AS (
  SELECT doc_id, text, source, lang, n_chars,
  {_truth_cols()}
  FROM documents),
probs AS (
  SELECT *,
  {_prob_cols()}
  FROM truth),
scored AS (
  SELECT doc_id AS row_id, text, source, lang, n_chars,
  {", ".join(f"true_{n}" for n in N)},
  {", ".join(f"prob_{n}" for n in N)},
  {", ".join(f"CASE WHEN prob_{n} > 0.5e0 THEN 1 ELSE 0 END AS pred_{n}" for n in N)}
  FROM probs)"""


def _sum(expr_fmt: str, sep: str = " + ") -> str:
    return sep.join(expr_fmt.format(n=n) for n in N)


ROWM_CTE = SCORED_CTE + f""",
rowm AS (
  SELECT *,
    {_sum("true_{n}*pred_{n}")} AS n_inter,
    {_sum("true_{n}")} AS n_true,
    {_sum("pred_{n}")} AS n_pred,
    {_sum("greatest(true_{n}, pred_{n})")} AS n_union,
    CASE WHEN {_sum("true_{n} = pred_{n}", " AND ")} THEN 1 ELSE 0 END AS exact
  FROM scored),
rowx AS (
  SELECT *,
    CASE WHEN n_union = 0 THEN 1.0e0 ELSE n_inter / n_union END AS jaccard,
    CASE WHEN n_pred > 0 THEN n_inter / n_pred WHEN n_true = 0 THEN 1.0e0 ELSE 0.0e0 END AS sp,
    CASE WHEN n_true > 0 THEN n_inter / n_true WHEN n_pred = 0 THEN 1.0e0 ELSE 0.0e0 END AS sr
  FROM rowm),
rowf AS (
  SELECT *, CASE WHEN sp + sr > 0 THEN 2.0e0 * sp * sr / (sp + sr) ELSE 0.0e0 END AS sf
  FROM rowx)"""


def _sums_cte(source: str = "rowf", group: str = "") -> str:
    parts = ["count(*) AS n"]
    for n in N:
        parts += [
            f"CAST(sum(CASE WHEN true_{n}=1 AND pred_{n}=1 THEN 1 ELSE 0 END) AS BIGINT) AS tp_{n}",
            f"CAST(sum(CASE WHEN true_{n}=0 AND pred_{n}=1 THEN 1 ELSE 0 END) AS BIGINT) AS fp_{n}",
            f"CAST(sum(CASE WHEN true_{n}=1 AND pred_{n}=0 THEN 1 ELSE 0 END) AS BIGINT) AS fn_{n}",
            f"CAST(sum(CASE WHEN true_{n}=0 AND pred_{n}=0 THEN 1 ELSE 0 END) AS BIGINT) AS tn_{n}",
        ]
    parts += ["CAST(sum(exact) AS BIGINT) AS n_exact", "CAST(sum(n_true) AS BIGINT) AS n_label_total",
              "CAST(sum(CASE WHEN n_true > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_multi",
              "CAST(sum(CASE WHEN n_true > 1 THEN exact ELSE 0 END) AS BIGINT) AS n_multi_exact",
              "CAST(sum(1 - exact) AS BIGINT) AS n_mismatch",
              "sum(sp) AS s_sp", "sum(sr) AS s_sr", "sum(sf) AS s_sf", "sum(jaccard) AS s_j"]
    sel = (group + ", " if group else "") + ",\n    ".join(parts)
    gb = f" GROUP BY {group}" if group else ""
    return f"sums AS (SELECT {sel} FROM {source}{gb})"


def _div(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0e0 ELSE ({num}) / ({den}) END"


def _per_label_union(group: str = "") -> str:
    g = group + ", " if group else ""
    rows = []
    for i, n in enumerate(N):
        rows.append(
            f"SELECT {g}'{n}' AS label, {i} AS label_index, tp_{n} AS tp, fp_{n} AS fp, "
            f"fn_{n} AS fn, tn_{n} AS tn, n FROM sums")
    return "\nUNION ALL\n".join(rows)


PER_LABEL = f"""WITH {ROWM_CTE},
{_sums_cte()},
lab AS ({_per_label_union()})
SELECT label, label_index, tp, fp, fn, tn, tp + fn AS support,
  {_div("tp", "tp + fp")} AS precision,
  {_div("tp", "tp + fn")} AS recall,
  {_div("2 * tp", "2 * tp + fp + fn")} AS f1,
  (tp + tn) / n AS accuracy
FROM lab"""


def _mean(fmt: str) -> str:
    return "(" + " + ".join(fmt.format(n=n) for n in N) + f") / {len(N)}"


MACRO = f"""WITH {ROWM_CTE},
{_sums_cte()}
SELECT n,
  round({_mean("(" + _div("tp_{n}", "tp_{n} + fp_{n}") + ")")}, 6) AS macro_precision,
  round({_mean("(" + _div("tp_{n}", "tp_{n} + fn_{n}") + ")")}, 6) AS macro_recall,
  round({_mean("(" + _div("2 * tp_{n}", "2 * tp_{n} + fp_{n} + fn_{n}") + ")")}, 6) AS macro_f1,
  round({_mean("((tp_{n} + tn_{n}) / n)")}, 6) AS macro_accuracy,
  round(s_sp / n, 6) AS sample_precision,
  round(s_sr / n, 6) AS sample_recall,
  round(s_sf / n, 6) AS sample_f1,
  round(s_j / n, 6) AS jaccard,
  n_exact,
  round(n_exact / n, 6) AS exact_match_ratio,
  round(({_sum("fp_{n} + fn_{n}")}) / (n * {len(N)}), 6) AS hamming_loss,
  n_mismatch
FROM sums"""

CARDINALITY = f"""WITH {SCORED_CTE},
k AS (SELECT {_sum("true_{n}")} AS n_labels FROM scored),
c AS (SELECT n_labels, count(*) AS n_texts FROM k GROUP BY n_labels),
b AS (SELECT max(n_labels) AS mx, sum(n_texts) AS n FROM c),
spine AS (SELECT unnest(generate_series(1, greatest(mx, 1))) AS n_labels, n, mx FROM b)
SELECT CAST(s.n_labels AS INTEGER) AS n_labels, CAST(coalesce(c.n_texts, 0) AS BIGINT) AS n_texts,
  round(coalesce(c.n_texts, 0) * 100.0e0 / s.n, 6) AS pct
FROM spine s LEFT JOIN c ON s.n_labels = c.n_labels WHERE s.n_labels <= s.mx"""

EXACT = f"""WITH {ROWM_CTE},
{_sums_cte()}
SELECT n, n_label_total, round(n_label_total / n, 6) AS labels_per_text,
  n_exact, round(n_exact * 100.0e0 / n, 6) AS pct_exact,
  n_multi, n_multi_exact,
  round({_div("n_multi_exact * 100.0e0", "n_multi")}, 6) AS pct_multi_exact,
  {", ".join(f"round((tp_{n} + tn_{n}) / n, 6) AS accuracy_{n}" for n in N)}
FROM sums"""

CONFUSION = f"""WITH {ROWM_CTE},
{_sums_cte()},
lab AS ({_per_label_union()})
SELECT label, label_index, 0 AS "true", 0 AS pred, tn AS n FROM lab
UNION ALL SELECT label, label_index, 0, 1, fp FROM lab
UNION ALL SELECT label, label_index, 1, 0, fn FROM lab
UNION ALL SELECT label, label_index, 1, 1, tp FROM lab"""


def _bce_terms() -> str:
    terms = []
    for n in N:
        p = f"least(greatest(prob_{n}, 1e-15), 1.0e0 - 1e-15)"
        z = f"ln({p} / (1.0e0 - {p}))"
        terms.append(f"(greatest({z}, 0.0e0) - {z} * CAST(true_{n} AS DOUBLE) + ln(1.0e0 + exp(-abs({z}))))")
    return " + ".join(terms)


BCE = f"""WITH {SCORED_CTE}
SELECT count(*) AS n, round(sum({_bce_terms()}) / (count(*) * {len(N)}), 6) AS bce_loss
FROM scored"""


def _names_sql(cond_fmt: str) -> str:
    return "concat_ws(', ', " + ", ".join(
        f"CASE WHEN {cond_fmt.format(n=n)} THEN '{n}' END" for n in N) + ")"


ROW_SET = f"""WITH {ROWM_CTE}
SELECT row_id, n_inter, n_true, n_pred, n_union, exact,
  round(jaccard, 6) AS jaccard, round(sp, 6) AS sample_precision,
  round(sr, 6) AS sample_recall, round(sf, 6) AS sample_f1,
  {_names_sql("true_{n} = 1 AND pred_{n} = 0")} AS missing,
  {_names_sql("pred_{n} = 1 AND true_{n} = 0")} AS extra
FROM rowf"""

QUALITY = f"""WITH q AS (
  SELECT l.doc_id, l.quality AS true_quality, l.toxic AS true_toxic,
    CASE WHEN d.n_chars BETWEEN 200 AND 6000 THEN 1 ELSE 0 END AS pred_quality,
    CASE WHEN d.n_chars % 7 = 0 THEN 1 ELSE 0 END AS pred_toxic
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
sums AS (SELECT count(*) AS n,
  {", ".join(f"CAST(sum(CASE WHEN true_{n}=1 AND pred_{n}=1 THEN 1 ELSE 0 END) AS BIGINT) AS tp_{n}, "
             f"CAST(sum(CASE WHEN true_{n}=0 AND pred_{n}=1 THEN 1 ELSE 0 END) AS BIGINT) AS fp_{n}, "
             f"CAST(sum(CASE WHEN true_{n}=1 AND pred_{n}=0 THEN 1 ELSE 0 END) AS BIGINT) AS fn_{n}, "
             f"CAST(sum(CASE WHEN true_{n}=0 AND pred_{n}=0 THEN 1 ELSE 0 END) AS BIGINT) AS tn_{n}"
             for n in ("quality", "toxic"))}
  FROM q),
lab AS (
  SELECT 'quality' AS label, 0 AS label_index, tp_quality AS tp, fp_quality AS fp,
    fn_quality AS fn, tn_quality AS tn, n FROM sums
  UNION ALL
  SELECT 'toxic', 1, tp_toxic, fp_toxic, fn_toxic, tn_toxic, n FROM sums)
SELECT label, label_index, tp, fp, fn, tn, tp + fn AS support,
  {_div("tp", "tp + fp")} AS precision,
  {_div("tp", "tp + fn")} AS recall,
  {_div("2 * tp", "2 * tp + fp + fn")} AS f1,
  (tp + tn) / n AS accuracy
FROM lab"""

UNLABELLED = f"""WITH {SCORED_CTE}
SELECT count(*) AS n,
  (greatest({", ".join(f"coalesce(max(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END), 0)" for c in L.true_cols)}) = 0) AS is_unlabelled,
  {", ".join(f"CAST(sum(CASE WHEN {c} IS NULL{' OR isnan(' + c + ')' if c.startswith('prob_') else ''} THEN 1 ELSE 0 END) AS BIGINT) AS invalid_{c}" for c in L.true_cols + L.prob_cols)}
FROM scored"""


ORACLE = {
    "per_label_metrics": PER_LABEL,
    "macro_sample_metrics": MACRO,
    "cardinality_histogram": CARDINALITY,
    "exact_match_multilabel": EXACT,
    "confusion_matrix": CONFUSION,
    "bce_loss": BCE,
    "row_set_metrics": ROW_SET,
    "quality_metrics": QUALITY,
    "unlabelled_check": UNLABELLED,
}


# ------------------------------------------------------------- corpus build

EMOJI = EMOJI_PATTERN


def _clean(x: str) -> str:
    s = f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '{EMOJI}', '', 'g'), '\\s+', ' ', 'g'))"
    for p in ("[NAME]", "[USER]", "[URL]"):
        s = f"replace({s}, '{p}', '')"
    return s


def _ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return (f"CASE WHEN {_ws(x)} = '' THEN []::VARCHAR[] "
            f"ELSE string_split({_ws(x)}, ' ') END")


def _draw(*parts: str, digits: int = 8) -> str:
    inner = " || ':' || ".join(["'42'"] + [f"CAST({p} AS VARCHAR)" if not p.startswith("'") else p
                                           for p in parts])
    return f"('0x' || substr(md5({inner}), 1, {digits}))::BIGINT"


def _key(x: str = "row_id") -> str:
    return f"md5(CAST({x} AS VARCHAR) || ':42')"


DIRTY = f"""WITH d AS (
  SELECT doc_id AS row_id,
    CASE WHEN doc_id % 5 = 0 THEN concat('[NAME] ', text)
         WHEN doc_id % 5 = 1 THEN concat(text, '  [USER]')
         WHEN doc_id % 5 = 2 THEN concat('\U0001F600 ', text, ' [URL]')
         WHEN doc_id % 25 = 3 THEN '[NAME]'
         WHEN doc_id % 25 = 8 THEN '   ' ELSE text END AS text
  FROM documents),
c AS (SELECT row_id, {_clean("text")} AS clean FROM d)
SELECT row_id, md5(clean) AS text_md5, CAST(length(clean) AS INTEGER) AS n_chars, clean = '' AS is_empty FROM c"""

LIST_CTE = f"""lst AS (
  SELECT doc_id AS row_id, {_clean("text")} AS text, source,
    list_distinct([doc_id % 28, (doc_id * 7) % 28, (doc_id * 11) % 28]) AS ids
  FROM documents),
lstm AS (
  SELECT row_id, text, source,
    CAST(list_has_any(ids, [2, 3]) AS INTEGER) AS anger,
    CAST(list_has_any(ids, [14, 19]) AS INTEGER) AS fear,
    CAST(list_has_any(ids, [13, 17, 18, 20]) AS INTEGER) AS joy,
    CAST(list_has_any(ids, [9, 16, 24, 25]) AS INTEGER) AS sadness,
    CAST(list_has_any(ids, [22, 26]) AS INTEGER) AS surprise
  FROM lst),
lstf AS (SELECT * FROM lstm WHERE anger + fear + joy + sadness + surprise > 0)"""

SINGLE_CTE = f"""one AS (
  SELECT doc_id AS row_id, {_clean("text")} AS text, source, CAST(doc_id % 6 AS INTEGER) AS label
  FROM documents),
onem AS (
  SELECT row_id, text, source, label,
    CAST(label = 3 AS INTEGER) AS anger, CAST(label = 4 AS INTEGER) AS fear,
    CAST(label = 1 AS INTEGER) AS joy, CAST(label = 0 AS INTEGER) AS sadness,
    CAST(label = 5 AS INTEGER) AS surprise
  FROM one WHERE text <> '')"""

LAB_CTE = f"""lab AS (
  SELECT doc_id AS row_id, text, source, lang,
  {_truth_cols("")}
  FROM documents)"""

LAB_CLEAN_CTE = f"""labc AS (
  SELECT row_id, {_clean("text")} AS text, {", ".join(N)} FROM lab)"""

COMBINED_CTE = f"""{LAB_CTE},
{LAB_CLEAN_CTE},
{LIST_CTE},
{SINGLE_CTE},
comb AS (
  SELECT row_id, text, {", ".join(N)}, 'labelled' AS source FROM labc
  UNION ALL SELECT row_id, text, {", ".join(N)}, 'list_corpus' FROM lstf
  UNION ALL SELECT row_id, text, {", ".join(N)}, 'single_corpus' FROM onem)"""

MULTIHOT_LIST = f"""WITH {LIST_CTE}
SELECT row_id, {", ".join(N)}, md5(text) AS text_md5 FROM lstf"""

MULTIHOT_CLASS = f"""WITH {SINGLE_CTE}
SELECT row_id, label, {", ".join(N)} FROM onem"""

CORPUS_UNION = f"""WITH {COMBINED_CTE}
SELECT source, row_id, {", ".join(N)}, md5(text) AS text_md5 FROM comb"""


def _label_counts_sql(src: str, group: str = "", p: str = "") -> str:
    g = group + ", " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    sums = ", ".join(f"CAST(sum(CASE WHEN {n} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c_{n}" for n in N)
    rows = "\nUNION ALL\n".join(
        f"SELECT {g}'{n}' AS label, {i} AS label_index, c_{n} AS count, n_rows FROM {p}w"
        for i, n in enumerate(N))
    return f"""{p}w AS (SELECT {g}count(*) AS n_rows, {sums} FROM {src}{gb}),
{p}lc AS ({rows})"""


LABEL_COUNTS = f"""WITH {LAB_CTE},
{_label_counts_sql("lab")}
SELECT label, label_index, count, n_rows, round({_div("count", "n_rows")}, 6) AS frequency FROM lc"""


def _cooc() -> str:
    rows = []
    for i, a in enumerate(N):
        for j, b in enumerate(N):
            rows.append(f"SELECT '{a}' AS label_a, '{b}' AS label_b, {i} AS index_a, {j} AS index_b, "
                        f"CAST(sum(CASE WHEN {a} = 1 AND {b} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM lab")
    return "\nUNION ALL\n".join(rows)


LABEL_COOC = f"""WITH {LAB_CTE}
{_cooc()}"""

LABEL_COMBOS = f"""WITH {LAB_CTE},
k AS (SELECT {", ".join(f"CASE WHEN {n} = 1 THEN 1 ELSE 0 END AS {n}" for n in N)} FROM lab)
SELECT {", ".join(N)}, count(*) AS n,
  CASE WHEN {_names_sql("{n} = 1")} = '' THEN 'none' ELSE {_names_sql("{n} = 1")} END AS labels
FROM k GROUP BY {", ".join(N)}"""

SOURCE_DIST = f"""WITH {COMBINED_CTE},
{_label_counts_sql("comb", "source")}
SELECT source, label, label_index, count, n_rows, round(count * 100.0e0 / n_rows, 6) AS pct FROM lc"""

COUNTS_ONLY = f"""cnt AS (SELECT {", ".join(f"sum(CASE WHEN {n} = 1 THEN 1 ELSE 0 END) AS c_{n}" for n in N)} FROM lab)"""

SAMPLE_WEIGHTS_CTE = f"""{LAB_CTE},
{COUNTS_ONLY},
wt AS (
  SELECT lab.*, ({" + ".join(f"CASE WHEN {n} IS NULL OR {n} <> 0 THEN 1.0e0 / c_{n} ELSE 0.0e0 END" for n in N)}) AS w0
  FROM lab, cnt),
wts AS (SELECT *, CASE WHEN w0 > 0 THEN w0 ELSE 1.0e0 END AS weight FROM wt)"""

SAMPLE_WEIGHTS = f"""WITH {SAMPLE_WEIGHTS_CTE}
SELECT row_id, round(weight, 6) AS weight FROM wts"""

PLAN_CTE = f"""{_label_counts_sql("lab")},
pl0 AS (SELECT *, max(count) OVER () AS target FROM lc),
plan AS (
  SELECT label, label_index, count, target,
    CAST(CASE WHEN count > 0 THEN target - count END AS BIGINT) AS quota,
    CAST(CASE WHEN count > 0 THEN (target - count) // count END AS BIGINT) AS full_copies,
    CAST(CASE WHEN count > 0 THEN (target - count) % count END AS BIGINT) AS remainder,
    count = 0 AS skipped
  FROM pl0)"""

OVERSAMPLE_PLAN = f"""WITH {LAB_CTE},
{PLAN_CTE}
SELECT * FROM plan"""

_PAIRS = "\n  UNION ALL ".join(
    f"SELECT row_id, text, source, {', '.join(N)}, '{n}' AS copy_label FROM lab WHERE {n} = 1" for n in N)

SYNTH_CTE = f"""{LAB_CTE},
{PLAN_CTE},
pairs AS ({_PAIRS}),
ranked AS (
  SELECT p.*, row_number() OVER (PARTITION BY copy_label ORDER BY {_key()}, row_id) AS rk FROM pairs p),
cp AS (
  SELECT r.*, pl.full_copies + CASE WHEN r.rk <= pl.remainder THEN 1 ELSE 0 END AS copies
  FROM ranked r JOIN plan pl ON r.copy_label = pl.label WHERE pl.quota > 0),
syn AS (
  SELECT cp.*, CAST(unnest(generate_series(1, copies)) AS BIGINT) AS copy_no FROM cp WHERE copies > 0)"""

AUG_CTE = f"""sw AS (
  SELECT *, {_words("text")} AS w,
    {_draw("row_id", "copy_label", "copy_no", "'kind'")} % 3 AS kind,
    {_draw("row_id", "copy_label", "copy_no", "'a'")} AS d1,
    {_draw("row_id", "copy_label", "copy_no", "'b'")} AS d2,
    {_draw("row_id", "copy_label", "copy_no", "'d'")} AS d3
  FROM syn),
sp AS (
  SELECT *, len(w) AS nw FROM sw),
sq AS (
  SELECT *, d1 % nw AS pa, d3 % nw AS pd FROM sp WHERE nw > 3
  UNION ALL SELECT *, NULL, NULL FROM sp WHERE nw <= 3),
sr AS (
  SELECT *, CASE WHEN nw > 3 THEN (pa + 1 + d2 % (nw - 1)) % nw END AS pb FROM sq),
ss AS (
  SELECT *, CASE WHEN nw > 3 AND kind IN (0, 2) THEN
      list_transform(w, lambda x, i: CASE WHEN i - 1 = pa THEN w[pb + 1] WHEN i - 1 = pb THEN w[pa + 1] ELSE x END)
    ELSE w END AS w2 FROM sr),
st AS (
  SELECT *, CASE WHEN nw > 3 AND kind IN (1, 2) THEN list_filter(w2, lambda x, i: i - 1 <> pd) ELSE w2 END AS w3
  FROM ss)"""

OVERSAMPLE_ROWS = f"""WITH {SYNTH_CTE},
{AUG_CTE}
SELECT row_id AS origin_id, CAST(NULL AS VARCHAR) AS copy_label, CAST(0 AS BIGINT) AS copy_no,
  {", ".join(N)}, source, md5(text) AS text_md5 FROM lab
UNION ALL
SELECT row_id, copy_label, copy_no, {", ".join(N)}, source, md5(array_to_string(w3, ' ')) FROM st"""

BALANCED = f"""WITH {SYNTH_CTE},
allr AS (SELECT {", ".join(N)} FROM lab UNION ALL SELECT {", ".join(N)} FROM syn),
{_label_counts_sql("allr", p="b")}
SELECT label, label_index, count, n_rows, round({_div("count", "n_rows")}, 6) AS frequency FROM blc"""

_STRATUM = "concat(" + ", ".join(f"CASE WHEN {n} = 1 THEN '1' ELSE '0' END" for n in N) + ")"

STRATIFIED = f"""WITH {LAB_CTE},
ls AS (SELECT row_id, {_STRATUM} AS stratum FROM lab),
st AS (SELECT stratum, count(*) AS n_s FROM ls GROUP BY stratum),
s1 AS (SELECT *, sum(n_s) OVER () AS n FROM st),
s2 AS (SELECT *, n - CAST(ceil(n * 0.1e0) AS BIGINT) AS n_train_total FROM s1),
s4 AS (SELECT *, CAST(n_train_total * n_s // n AS BIGINT) AS fl, n_train_total * n_s % n AS rem FROM s2),
s5 AS (SELECT *, n_train_total - sum(fl) OVER () AS short,
         row_number() OVER (ORDER BY rem DESC, n_s DESC, stratum) AS rk FROM s4),
alloc AS (SELECT stratum, n_s - (fl + CASE WHEN rk <= short THEN 1 ELSE 0 END) AS k FROM s5),
rk AS (SELECT ls.*, row_number() OVER (PARTITION BY ls.stratum ORDER BY {_key()}, row_id) AS r FROM ls)
SELECT rk.row_id, rk.stratum, CASE WHEN rk.r <= alloc.k THEN 'val' ELSE 'train' END AS split
FROM rk JOIN alloc ON rk.stratum = alloc.stratum"""

WEIGHTED = f"""WITH {SAMPLE_WEIGHTS_CTE},
ek AS (SELECT row_id, weight,
  ln((CAST({_draw("row_id", "'u'", digits=15)} AS DOUBLE) + 0.5e0) / 1152921504606846976.0e0) / weight AS es_key FROM wts)
SELECT row_id, round(weight, 6) AS weight FROM ek ORDER BY es_key DESC, row_id LIMIT 100"""

SHARDS = f"""WITH {LAB_CTE},
sh AS (SELECT row_id, {_draw("row_id", "'shard'")} % 4 AS shard, {_key()} AS k FROM lab),
po AS (SELECT row_id, shard, row_number() OVER (PARTITION BY shard ORDER BY k, row_id) - 1 AS position,
  count(*) OVER (PARTITION BY shard) AS n FROM sh),
-- fewer than 32 rows of the epoch go: what the shards leave over is batched together
rest AS (SELECT row_id, 4 AS shard, row_number() OVER (ORDER BY shard, position) - 1 AS position,
  count(*) OVER () AS n FROM po WHERE position >= (n // 32) * 32),
cut AS (SELECT row_id, shard, position FROM po WHERE position < (n // 32) * 32
  UNION ALL SELECT row_id, shard, position FROM rest WHERE position < (n // 32) * 32)
SELECT row_id, CAST(shard AS BIGINT) AS shard, CAST(position AS BIGINT) AS position,
  CAST(position // 32 AS BIGINT) AS batch_in_shard
FROM cut"""

ORACLE.update({
    "clean_text": DIRTY,
    "multihot_from_list": MULTIHOT_LIST,
    "multihot_from_class": MULTIHOT_CLASS,
    "corpus_union": CORPUS_UNION,
    "label_counts": LABEL_COUNTS,
    "label_cooccurrence": LABEL_COOC,
    "label_combinations": LABEL_COMBOS,
    "source_distribution": SOURCE_DIST,
    "sample_weights": SAMPLE_WEIGHTS,
    "oversample_plan": OVERSAMPLE_PLAN,
    "oversample_rows": OVERSAMPLE_ROWS,
    "balanced_distribution": BALANCED,
    "stratified_split": STRATIFIED,
    "weighted_sample": WEIGHTED,
    "training_shards": SHARDS,
})


# ----------------------------------------------------------- error analysis

def _miss(n: str) -> str:
    return f"true_{n} * (1 - pred_{n})"


def _extra(n: str) -> str:
    return f"pred_{n} * (1 - true_{n})"


MISSING_EXTRA = f"""WITH {ROWM_CTE},
agg AS (SELECT count(*) AS n, sum(1 - exact) AS n_mismatch,
  {", ".join(f"sum({_miss(n)}) AS m_{n}, sum({_extra(n)}) AS e_{n}" for n in N)}
  FROM rowm),
r AS ({" UNION ALL ".join(f"SELECT '{n}' AS label, {i} AS label_index, CAST(m_{n} AS BIGINT) AS n_missing, CAST(e_{n} AS BIGINT) AS n_extra, n, n_mismatch FROM agg" for i, n in enumerate(N))})
SELECT label, label_index, n_missing, n_extra,
  CAST(row_number() OVER (ORDER BY n_missing DESC, label_index) AS INTEGER) AS missing_rank,
  CAST(row_number() OVER (ORDER BY n_extra DESC, label_index) AS INTEGER) AS extra_rank,
  CAST(n_mismatch AS BIGINT) AS n_mismatch, round(n_mismatch / n, 6) AS mismatch_ratio
FROM r"""

_TRUE_NAMES = _names_sql("true_{n} = 1")
_PRED_NAMES = _names_sql("pred_{n} = 1")

MISMATCH_EXAMPLES = f"""WITH {ROWM_CTE}
SELECT row_id, md5(text) AS text_md5, {_TRUE_NAMES} AS true_labels, {_PRED_NAMES} AS pred_labels,
  {_names_sql("true_{n} = 1 AND pred_{n} = 0")} AS missing,
  {_names_sql("pred_{n} = 1 AND true_{n} = 0")} AS extra
FROM rowm WHERE exact = 0 ORDER BY row_id LIMIT 10"""

MULTILABEL_EXAMPLES = f"""WITH {ROWM_CTE}
SELECT row_id, md5(text) AS text_md5, {_TRUE_NAMES} AS true_labels, {_PRED_NAMES} AS pred_labels,
  exact = 1 AS perfect_match
FROM rowm WHERE n_true > 1 ORDER BY row_id LIMIT 5"""

DETAILED = f"""WITH {ROWM_CTE}
SELECT row_id, md5(text) AS text_md5, {", ".join(f"pred_{n}" for n in N)},
  {", ".join(f"round(prob_{n}, 6) AS prob_{n}" for n in N)}, {", ".join(f"true_{n}" for n in N)},
  {_PRED_NAMES} AS predicted_labels, {_TRUE_NAMES} AS true_labels,
  {_PRED_NAMES} = {_TRUE_NAMES} AS correct,
  round(CASE WHEN n_union = 0 THEN 1.0e0 ELSE n_inter / n_union END, 6) AS jaccard_similarity
FROM rowm"""

ANN_CTE = f"""{SCORED_CTE},
ks AS (SELECT * FROM (VALUES (1), (2), (3)) t(k)),
ann AS (
  SELECT 'A' || CAST(k AS VARCHAR) AS annotator_id, doc_id AS text_id, text,
  {", ".join(f"CASE WHEN (doc_id * 13 + {i} + k) % 23 = 0 THEN 1 - true_{n} ELSE true_{n} END AS true_{n}" for i, n in enumerate(N))}
  FROM truth, ks WHERE doc_id % k = 0),
j AS (
  SELECT ann.*, {", ".join(f"s.pred_{n}" for n in N)}
  FROM ann JOIN scored s ON ann.text_id = s.row_id)"""

_PAIR_ROWS = " UNION ALL ".join(
    f"SELECT '{m}' AS true_label, '{e}' AS pred_label, {i} AS true_index, {j} AS pred_index, "
    f"CAST(sum(({_miss(m)}) * ({_extra(e)})) AS BIGINT) AS n FROM j"
    for i, m in enumerate(N) for j, e in enumerate(N) if i != j)

CONFUSION_PAIRS = f"""WITH {ANN_CTE},
p AS ({_PAIR_ROWS})
SELECT *, CAST(row_number() OVER (ORDER BY n DESC, true_index, pred_index) AS INTEGER) AS rank
FROM p WHERE n > 0"""

AGREEMENT = f"""WITH {ANN_CTE},
g AS (SELECT annotator_id, count(*) AS n,
  {", ".join(f"CAST(sum(CASE WHEN true_{n}=1 AND pred_{n}=1 THEN 1 ELSE 0 END) AS BIGINT) AS tp_{n}, CAST(sum(CASE WHEN true_{n}=0 AND pred_{n}=1 THEN 1 ELSE 0 END) AS BIGINT) AS fp_{n}, CAST(sum(CASE WHEN true_{n}=1 AND pred_{n}=0 THEN 1 ELSE 0 END) AS BIGINT) AS fn_{n}, CAST(sum(CASE WHEN true_{n}=0 AND pred_{n}=0 THEN 1 ELSE 0 END) AS BIGINT) AS tn_{n}" for n in N)},
  sum(CASE WHEN {_sum("true_{n} = pred_{n}", " AND ")} THEN 1 ELSE 0 END) AS n_exact
  FROM j GROUP BY annotator_id),
r AS ({" UNION ALL ".join(f"SELECT annotator_id, '{n}' AS label, {i} AS label_index, tp_{n} AS tp, fp_{n} AS fp, fn_{n} AS fn, tn_{n} AS tn, n, n_exact, ({_sum('fp_{n} + fn_{n}')}) AS errs FROM g" for i, n in enumerate(N))})
SELECT annotator_id, label, label_index, tp, fp, fn, tn,
  round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) END, 6) AS agreement,
  round(CASE WHEN tp + fp + fn + tn > 0 THEN (fp + fn) / (tp + fp + fn + tn) END, 6) AS disagreement_rate,
  round({_div("fp", "fp + tn")}, 6) AS false_positive_rate,
  round({_div("fn", "fn + tp")}, 6) AS false_negative_rate,
  n, round(n_exact / n, 6) AS exact_match_ratio, round(n_exact / n, 6) AS subset_accuracy,
  round(errs / (n * {len(N)}), 6) AS hamming_loss
FROM r"""

_ERR_ROWS = " UNION ALL ".join(
    f"SELECT annotator_id, text_id, text, human_labels, model_labels, '{n}' AS label, {i} AS label_index, "
    f"CASE WHEN pred_{n} > true_{n} THEN 'fp' ELSE 'fn' END AS kind FROM jn WHERE pred_{n} <> true_{n}"
    for i, n in enumerate(N))

EXAMPLES_CTE = f"""{ANN_CTE},
jn AS (SELECT j.*, {_TRUE_NAMES} AS human_labels, {_PRED_NAMES} AS model_labels FROM j),
e AS ({_ERR_ROWS}),
t AS (SELECT annotator_id, label, kind, count(*) AS n_total FROM e GROUP BY ALL),
x AS (SELECT e.*, row_number() OVER (PARTITION BY annotator_id, label, kind ORDER BY text_id) AS example_no FROM e)"""
EXAMPLES = f"""WITH {EXAMPLES_CTE}
SELECT x.annotator_id, x.label, x.label_index, x.kind, t.n_total, CAST(x.example_no AS INTEGER) AS example_no,
  x.text_id, md5(x.text) AS text_md5,
  CASE WHEN x.kind = 'fp' THEN x.human_labels ELSE x.model_labels END AS other_labels
FROM x JOIN t ON x.annotator_id = t.annotator_id AND x.label = t.label AND x.kind = t.kind
WHERE x.example_no <= 3"""

RAW = f"""WITH {ANN_CTE}
SELECT annotator_id, text_id, md5(text) AS text_md5,
  CASE WHEN {_PRED_NAMES} = '' THEN 'none' ELSE {_PRED_NAMES} END AS model_labels,
  CASE WHEN {_TRUE_NAMES} = '' THEN 'none' ELSE {_TRUE_NAMES} END AS human_labels
FROM j"""

WORKLIST = f"""WITH {ANN_CTE},
todo AS (SELECT 'A' || CAST(k AS VARCHAR) AS annotator_id, s.row_id AS text_id FROM scored s, ks)
SELECT annotator_id, text_id FROM todo
WHERE NOT EXISTS (SELECT 1 FROM ann WHERE ann.annotator_id = todo.annotator_id AND ann.text_id = todo.text_id)"""

_WORDS_CTE = f"""{ANN_CTE},
jn AS (SELECT j.*, '' AS human_labels, '' AS model_labels FROM j),
e AS ({_ERR_ROWS}),
wd AS (SELECT annotator_id, label, label_index, kind,
         unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) >= 3)) AS word FROM e),
wc AS (SELECT annotator_id, label, label_index, kind, word, count(*) AS n FROM wd GROUP BY ALL),
wr AS (SELECT *, row_number() OVER (PARTITION BY annotator_id, label, kind ORDER BY n DESC, word) AS rank FROM wc),
top AS (SELECT * FROM wr WHERE rank <= 3)"""

ERROR_WORDS = f"""WITH {_WORDS_CTE}
SELECT annotator_id, label, label_index, kind, word, n, CAST(rank AS INTEGER) AS rank FROM top"""

ADVICE = f"""WITH {_WORDS_CTE},
g AS (SELECT annotator_id, {", ".join(f"CAST(sum({_extra(n)}) AS BIGINT) AS fp_{n}, CAST(sum({_miss(n)}) AS BIGINT) AS fn_{n}" for n in N)}
  FROM j GROUP BY annotator_id),
b AS ({" UNION ALL ".join(f"SELECT annotator_id, '{n}' AS label, {i} AS label_index, fp_{n} AS fp, fn_{n} AS fn FROM g" for i, n in enumerate(N))}),
tw AS (SELECT annotator_id, label,
  string_agg(CASE WHEN kind = 'fp' THEN word END, ', ' ORDER BY rank) AS fp_words,
  string_agg(CASE WHEN kind = 'fn' THEN word END, ', ' ORDER BY rank) AS fn_words
  FROM top GROUP BY annotator_id, label)
SELECT b.annotator_id, b.label, b.label_index, b.fp, b.fn,
  round({_div("b.fp", "b.fp + b.fn")}, 6) AS fp_ratio,
  CASE WHEN {_div("b.fp", "b.fp + b.fn")} > 0.7e0 THEN 'raise threshold'
       WHEN {_div("b.fp", "b.fp + b.fn")} < 0.3e0 THEN 'lower threshold' ELSE 'keep threshold' END AS advice,
  coalesce(tw.fp_words, '') AS fp_words, coalesce(tw.fn_words, '') AS fn_words
FROM b LEFT JOIN tw ON b.annotator_id = tw.annotator_id AND b.label = tw.label"""

ORACLE.update({
    "discrepancy_missing_extra": MISSING_EXTRA,
    "confusion_pairs": CONFUSION_PAIRS,
    "mismatch_examples": MISMATCH_EXAMPLES,
    "multilabel_examples": MULTILABEL_EXAMPLES,
    "detailed_predictions": DETAILED,
    "annotator_agreement": AGREEMENT,
    "annotator_examples": EXAMPLES,
    "raw_comparisons": RAW,
    "annotation_worklist": WORKLIST,
    "error_words": ERROR_WORDS,
    "threshold_advice": ADVICE,
})


# ------------------------------------------------------------------ features

_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: length(x) > 0)"

VOCAB_CTE = f"""tok AS (SELECT doc_id AS row_id, {_TOK} AS t FROM documents),
cnt AS (SELECT tk AS token, count(*) AS n FROM (SELECT unnest(t) AS tk FROM tok) GROUP BY tk),
voc AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS token_id, n
        FROM cnt QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 4996)"""

VOCABULARY = f"""WITH {VOCAB_CTE}
SELECT token, token_id, n FROM voc"""

ENCODE = f"""WITH {VOCAB_CTE},
pos AS (SELECT row_id, unnest(t[1:126]) AS token,
          unnest(generate_series(0, least(len(t), 126) - 1)) AS pos FROM tok),
ids AS (SELECT p.row_id, list(coalesce(v.token_id, 3) ORDER BY p.pos) AS ids
        FROM pos p LEFT JOIN voc v ON p.token = v.token GROUP BY p.row_id),
enc AS (SELECT tok.row_id, len(tok.t) AS n_tokens, [0] || coalesce(ids.ids, []) || [2] AS r
        FROM tok LEFT JOIN ids ON tok.row_id = ids.row_id)
SELECT row_id,
  md5(array_to_string(r || list_transform(range(128 - len(r)), lambda x: 1), ' ')) AS ids_md5,
  CAST(len(r) AS INTEGER) AS mask_sum, CAST(n_tokens AS INTEGER) AS n_tokens, n_tokens > 126 AS truncated
FROM enc"""

ORACLE.update({
    "vocabulary": VOCABULARY,
    "encode_tokens": ENCODE,
})

ORACLE.update({
    "streaming_metrics": PER_LABEL,
    "streaming_clean": DIRTY,
})


# ------------------------------------------------------------ corpus build


def _synth_cte(src: str, p: str) -> str:
    """Oversampling plan, exact remainder selection and copies of ``src``
    (row_id, text, source, labels), with CTE names prefixed by ``p``."""
    pairs = "\n  UNION ALL ".join(
        f"SELECT row_id, text, source, {', '.join(N)}, '{n}' AS copy_label FROM {src} WHERE {n} = 1" for n in N)
    return f"""{_label_counts_sql(src, p=p)},
{p}pl0 AS (SELECT *, max(count) OVER () AS target FROM {p}lc),
{p}plan AS (
  SELECT label, count, target, target - count AS quota, (target - count) // count AS full_copies,
    (target - count) % count AS remainder FROM {p}pl0 WHERE count > 0),
{p}pairs AS ({pairs}),
{p}ranked AS (
  SELECT x.*, row_number() OVER (PARTITION BY copy_label ORDER BY {_key()}, row_id) AS rk FROM {p}pairs x),
{p}cp AS (
  SELECT r.*, pl.full_copies + CASE WHEN r.rk <= pl.remainder THEN 1 ELSE 0 END AS copies
  FROM {p}ranked r JOIN {p}plan pl ON r.copy_label = pl.label WHERE pl.quota > 0),
syn AS (
  SELECT {p}cp.*, CAST(unnest(generate_series(1, copies)) AS BIGINT) AS copy_no FROM {p}cp WHERE copies > 0)"""


def _split_cte(src: str, key: str, p: str) -> str:
    return f"""{p}ls AS (SELECT *, {_STRATUM} AS stratum FROM {src}),
{p}st AS (SELECT stratum, count(*) AS n_s FROM {p}ls GROUP BY stratum),
{p}s1 AS (SELECT *, sum(n_s) OVER () AS n FROM {p}st),
{p}s2 AS (SELECT *, n - CAST(ceil(n * 0.1e0) AS BIGINT) AS n_train_total FROM {p}s1),
{p}s4 AS (SELECT *, CAST(n_train_total * n_s // n AS BIGINT) AS fl, n_train_total * n_s % n AS rem FROM {p}s2),
{p}s5 AS (SELECT *, n_train_total - sum(fl) OVER () AS short,
         row_number() OVER (ORDER BY rem DESC, n_s DESC, stratum) AS rk FROM {p}s4),
{p}alloc AS (SELECT stratum, n_s - (fl + CASE WHEN rk <= short THEN 1 ELSE 0 END) AS k FROM {p}s5),
{p}rk AS (SELECT x.*, row_number() OVER (PARTITION BY x.stratum ORDER BY {_key(key)}, {key}) AS r FROM {p}ls x),
{p}out AS (SELECT x.*, CASE WHEN x.r <= a.k THEN 'val' ELSE 'train' END AS split
           FROM {p}rk x JOIN {p}alloc a ON x.stratum = a.stratum)"""


CORPUS_BUILD = f"""WITH {COMBINED_CTE},
lab2 AS (SELECT source || '-' || CAST(row_id AS VARCHAR) AS row_id, text, source, {", ".join(N)} FROM comb),
{_synth_cte("lab2", "k")},
{AUG_CTE},
allrows AS (
  SELECT row_id || '##0' AS row_key, source, {", ".join(N)}, md5(text) AS text_md5 FROM lab2
  UNION ALL
  SELECT row_id || '#' || copy_label || '#' || CAST(copy_no AS VARCHAR), source, {", ".join(N)},
    md5(array_to_string(w3, ' ')) FROM st),
{_split_cte("allrows", "row_key", "z")}
SELECT row_key, split, source, {", ".join(N)}, text_md5 FROM zout"""

ORACLE["corpus_build"] = CORPUS_BUILD


# ---------------------------------------------------------------- reporting

_PER = ["precision", "recall", "f1", "support", "accuracy"]
_OVR = ["macro_precision", "macro_recall", "macro_f1", "sample_precision", "sample_recall", "sample_f1",
        "jaccard", "exact_match_ratio", "hamming_loss", "n", "n_exact", "n_mismatch"]

METRICS_REPORT = f"""WITH pl AS ({PER_LABEL}),
ov AS ({MACRO})
{" UNION ALL ".join(f"SELECT 'per_label' AS section, label, '{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS value FROM pl" for m in _PER)}
UNION ALL
{" UNION ALL ".join(f"SELECT 'overall', CAST(NULL AS VARCHAR), '{m}', round(CAST({m} AS DOUBLE), 6) FROM ov" for m in _OVR)}"""

DEBUG_ROWS = f"""WITH {ROWM_CTE},
d AS (SELECT row_id,
  CASE WHEN n_pred > 0 THEN n_inter / n_pred ELSE 1.0e0 END AS p,
  CASE WHEN n_true > 0 THEN n_inter / n_true ELSE 1.0e0 END AS r FROM rowm)
SELECT row_id, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2.0e0 * p * r / (p + r) ELSE 0.0e0 END, 6) AS f1
FROM d ORDER BY row_id LIMIT 5"""

_NAMES28 = ["admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion", "curiosity",
            "desire", "disappointment", "disapproval", "disgust", "embarrassment", "excitement", "fear",
            "gratitude", "grief", "joy", "love", "nervousness", "optimism", "pride", "realization", "relief",
            "remorse", "sadness", "surprise", "neutral"]

DECODE = f"""WITH l0 AS (
  SELECT doc_id AS row_id, [doc_id % 28, (doc_id * 7) % 28, (doc_id * 11) % 28] AS raw FROM documents),
l AS (SELECT row_id, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS ids FROM l0)
SELECT row_id, array_to_string(list_transform(ids, lambda x: ({_NAMES28!r})[x + 1]), ', ') AS class_names
FROM l ORDER BY row_id LIMIT 5"""

SPLIT_COUNTS = f"""WITH {LAB_CTE},
{_split_cte("lab", "row_id", "q")}
SELECT split, count(*) AS n_rows FROM qout GROUP BY split"""

ORACLE.update({
    "metrics_report": METRICS_REPORT,
    "debug_row_metrics": DEBUG_ROWS,
    "decode_examples": DECODE,
    "split_counts": SPLIT_COUNTS,
})


# ------------------------------------------------------ train-time augmentation

_U = "4294967296.0e0"

AUGMENT = f"""WITH a0 AS (SELECT doc_id AS row_id, {_clean("text")} AS text FROM documents),
a1 AS (SELECT row_id, text, {_words("text")} AS w FROM a0),
a2 AS (SELECT *, len(w) AS n, len(w) // 10 AS n_drop,
  CAST({_draw("row_id", "'0'", "'pdrop'")} AS DOUBLE) / {_U} < 0.3e0 AS fd,
  CAST({_draw("row_id", "'0'", "'pswap'")} AS DOUBLE) / {_U} < 0.3e0 AS fs
  FROM a1),
a3 AS (SELECT *,
  CASE WHEN n_drop > 0 THEN list_transform(generate_series(1, n_drop),
       lambda k: {_draw("row_id", "'0'", "'drop'", "k")} % n) ELSE [] END AS di,
  CASE WHEN n > 0 THEN {_draw("row_id", "'0'", "'s1'")} % n END AS s1,
  CASE WHEN n > 0 THEN {_draw("row_id", "'0'", "'s2'")} % n END AS s2
  FROM a2),
a4 AS (SELECT *,
  CASE WHEN n <= 4 THEN text
       WHEN fs THEN array_to_string(list_transform(w, lambda x, i: CASE WHEN i - 1 = s1 THEN w[s2 + 1]
                                                   WHEN i - 1 = s2 THEN w[s1 + 1] ELSE x END), ' ')
       WHEN fd THEN array_to_string(list_filter(w, lambda x, i: NOT list_contains(di, i - 1)), ' ')
       ELSE array_to_string(w, ' ') END AS out
  FROM a3)
SELECT row_id, CAST(CASE WHEN {_ws("out")} = '' THEN 0 ELSE len(string_split({_ws("out")}, ' ')) END AS INTEGER) AS n_words,
  md5(out) AS text_md5
FROM a4"""

ORACLE["augment_words"] = AUGMENT


BOOT_CTE = f"""{LAB_CTE},
{PLAN_CTE},
pairs AS ({_PAIRS}),
ranked AS (
  SELECT x.*, row_number() OVER (PARTITION BY copy_label ORDER BY {_key()}, row_id) - 1 AS rk FROM pairs x),
dr AS (SELECT label AS copy_label, count AS n, unnest(generate_series(0, quota - 1)) AS j FROM plan WHERE quota > 0),
drk AS (SELECT copy_label, j, {_draw("copy_label", "j", "'boot'", digits=15)} % n AS rk FROM dr),
syn AS (SELECT r.row_id, r.text, r.source, {", ".join("r." + n for n in N)}, r.copy_label,
          CAST(d.j + 1 AS BIGINT) AS copy_no
        FROM drk d JOIN ranked r ON d.copy_label = r.copy_label AND d.rk = r.rk)"""

OVERSAMPLE_BOOT = f"""WITH {BOOT_CTE},
{AUG_CTE}
SELECT row_id AS origin_id, CAST(NULL AS VARCHAR) AS copy_label, CAST(0 AS BIGINT) AS copy_no,
  {", ".join(N)}, source, md5(text) AS text_md5 FROM lab
UNION ALL
SELECT row_id, copy_label, copy_no, {", ".join(N)}, source, md5(array_to_string(w3, ' ')) FROM st"""

ORACLE["oversample_bootstrap"] = OVERSAMPLE_BOOT

ORACLE["annotation_files"] = AGREEMENT
