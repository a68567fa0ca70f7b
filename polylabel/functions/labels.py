"""Column expressions over wide label columns (pure, JVM-side, codegen'd).

All row-level set logic works on 0/1 integer columns, so no arrays are built
unless the caller wants label names: |T & P| = sum(t*p), |T| = sum(t),
|P| = sum(p), |T | P| = sum(greatest(t, p)).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LabelSet


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(cols) -> Column:
    """Sum of 0/1 columns (B18 labels-per-row)."""
    return reduce(add, [F.coalesce(_c(c), F.lit(0)) for c in cols])


def multihot_from_ids(ids, class_map: dict[str, list[int]]) -> dict[str, Column]:
    """One 0/1 column per target label, 1 when any mapped class id is in
    the row's id list."""
    out = {}
    for label, ids_for_label in class_map.items():
        hit = F.arrays_overlap(_c(ids), F.array(*[F.lit(int(i)) for i in ids_for_label]))
        out[label] = F.coalesce(hit, F.lit(False)).cast("int")
    return out


def multihot_from_class(label, class_map: dict[int, str], labels: LabelSet) -> dict[str, Column]:
    """Single class id -> 0/1 per target label. Class ids mapped to a name
    outside ``labels`` (e.g. ``love``) set no target label."""
    out = {}
    for name in labels.names:
        ids = [k for k, v in class_map.items() if v == name]
        if ids:
            out[name] = _c(label).isin(ids).cast("int")
        else:
            out[name] = F.lit(0)
    return out


def decode_ids(ids, id_names: dict[int, str]) -> Column:
    """Class id list -> class name list through a literal map."""
    m = F.create_map(*[x for k, v in sorted(id_names.items()) for x in (F.lit(k), F.lit(v))])
    return F.transform(_c(ids), lambda x: F.element_at(m, x))


def label_names(flag_cols, names) -> Column:
    """Array of names whose flag is 1, in label order."""
    arr = F.array(*[F.when(_c(c) == 1, F.lit(n)) for c, n in zip(flag_cols, names)])
    return F.filter(arr, lambda x: x.isNotNull())


def label_string(flag_cols, names, empty: str = "") -> Column:
    """Names of set flags joined by ", " in label order."""
    s = F.concat_ws(", ", label_names(flag_cols, names))
    return s if empty == "" else F.when(s == "", F.lit(empty)).otherwise(s)


def threshold(prob, t: float = 0.5) -> Column:
    """Strict ``prob > t`` (0.5 -> 0)."""
    return (_c(prob) > F.lit(float(t))).cast("int")


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def row_counts(true_cols, pred_cols) -> dict[str, Column]:
    """Integer building blocks of every row-level set metric."""
    return {
        "n_inter": reduce(add, [_c(t) * _c(p) for t, p in zip(true_cols, pred_cols)]),
        "n_true": reduce(add, [_c(t) for t in true_cols]),
        "n_pred": reduce(add, [_c(p) for p in pred_cols]),
        "n_union": reduce(add, [F.greatest(_c(t), _c(p)) for t, p in zip(true_cols, pred_cols)]),
    }


def exact_match(true_cols, pred_cols) -> Column:
    """All label columns equal."""
    return reduce(lambda a, b: a & b, [_c(t) == _c(p) for t, p in zip(true_cols, pred_cols)])


def row_jaccard(n_inter, n_union) -> Column:
    """|T&P| / |T|P|, both empty -> 1.0."""
    return F.when(_c(n_union) == 0, F.lit(1.0)).otherwise(_c(n_inter) / _c(n_union))


def row_prf(n_inter, n_true, n_pred, empty: str = "standard") -> dict[str, Column]:
    """Row precision, recall, F1.

    ``standard``: empty prediction -> P = 1 if truth empty else 0; empty
    truth -> R = 1 if prediction empty else 0.
    ``one``: empty prediction -> P = 1 always; empty truth -> R = 1 always.
    F1 is 0 when P + R = 0.
    """
    i, nt, npred = _c(n_inter), _c(n_true), _c(n_pred)
    if empty == "standard":
        p_empty = F.when(nt == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        r_empty = F.when(npred == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    elif empty == "one":
        p_empty = F.lit(1.0)
        r_empty = F.lit(1.0)
    else:
        raise ValueError(f"unknown empty-set convention {empty!r}")
    p = F.when(npred > 0, i / npred).otherwise(p_empty)
    r = F.when(nt > 0, i / nt).otherwise(r_empty)
    f1 = F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
    return {"precision": p, "recall": r, "f1": f1}


def missing_labels(labels: LabelSet) -> Column:
    """Truth minus prediction, as label names."""
    return F.array_except(label_names(labels.true_cols, labels.names),
                          label_names(labels.pred_cols, labels.names))


def extra_labels(labels: LabelSet) -> Column:
    """Prediction minus truth, as label names."""
    return F.array_except(label_names(labels.pred_cols, labels.names),
                          label_names(labels.true_cols, labels.names))


def safe_div(num, den) -> Column:
    """num / den, 0.0 when den = 0 (zero-division convention of the metrics)."""
    return F.when(_c(den) == 0, F.lit(0.0)).otherwise(_c(num) / _c(den))
