"""SQL text for the metrics, written over the nine counts n00 ... n22."""

from __future__ import annotations


def cm_cte(name: str, source: str, by: str) -> str:
    cells = ", ".join(f"count(*) FILTER (y={i} AND yp={j}) AS n{i}{j}" for i in range(3) for j in range(3))
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"{name} AS (SELECT {group}{cells} FROM {source}{tail})"


N = "(" + "+".join(f"n{i}{j}" for i in range(3) for j in range(3)) + ")::double"


def row(i: int) -> str:
    return f"(n{i}0+n{i}1+n{i}2)::double"


def col(j: int) -> str:
    return f"(n0{j}+n1{j}+n2{j})::double"


_O = " + ".join(f"{(i - j) ** 2}*n{i}{j}" for i in range(3) for j in range(3) if i != j)
_E = " + ".join(f"{(i - j) ** 2}*{row(i)}*{col(j)}" for i in range(3) for j in range(3) if i != j)
QWK = f"(1 - (({_O})::double * {N}) / nullif({_E}, 0))"
MACRO_F1 = ("((" + " + ".join(f"coalesce(2.0::double*n{i}{i}/nullif({row(i)}+{col(i)},0),0)" for i in range(3)) + ") / nullif("
            + " + ".join(f"({row(i)}+{col(i)}>0)::int" for i in range(3)) + ",0))")


def recall(i: int, null: bool = False) -> str:
    r = f"(n{i}{i}/nullif({row(i)},0))"
    return r if null else f"coalesce({r},0.0::double)"


def selection(j: int) -> str:
    return f"({col(j)}/nullif({N},0))"


BALANCED = ("((" + "+".join(recall(i) for i in range(3)) + ") / nullif("
            + "+".join(f"({row(i)}>0)::int" for i in range(3)) + ",0))")


def lift_cte(name: str, source: str, by: str) -> str:
    """Plain windowed top-k; (by, lift_10, lift_20)."""
    over = f"PARTITION BY {by}" if by else ""
    g = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    def one(pct: str) -> str:
        return (f"coalesce((sum((y=0 and rn<=greatest(1,floor(n*{pct}::double)))::int)::double / max(greatest(1,floor(n*{pct}::double))))"
                f" / nullif(avg((y=0)::int::double),0), 0.0::double)")
    return (f"{name} AS (SELECT {g}{one('0.1')} AS lift_10, {one('0.2')} AS lift_20 FROM (SELECT *, "
            f"row_number() OVER ({over} ORDER BY p0 DESC, id) AS rn, count(*) OVER ({over}) AS n FROM {source}){tail})")


def metrics_select(by: str) -> str:
    return (f"{by}, {N}::bigint AS n, {QWK} AS qwk, {MACRO_F1} AS macro_f1, {BALANCED} AS balanced_acc, "
            f"{recall(0)} AS detractor_recall, {recall(0)} AS recall_detractor, {recall(1)} AS recall_passive, "
            f"{recall(2)} AS recall_promoter")


def evaluate_cte(name: str, source: str, by: str) -> str:
    """`evaluate` per group as CTEs cm_<name>, lf_<name>, <name>."""
    return ",\n".join([
        cm_cte(f"cm_{name}", source, by), lift_cte(f"lf_{name}", source, by),
        f"{name} AS (SELECT m.*, lift_10, lift_20 FROM (SELECT {metrics_select(by)} FROM cm_{name}) m "
        f"JOIN lf_{name} USING ({by}))"])


LONG_METRICS = {"qwk": "qwk", "macro_f1": "macro_f1", "balanced_acc": "balanced_acc",
                "detractor_recall": "detractor_recall", "lift_10": "lift@10", "lift_20": "lift@20"}


def long_cte(name: str, source: str, by: str, metrics=LONG_METRICS) -> str:
    arms = " UNION ALL ".join(f"SELECT {by}, '{label}' AS metric, {c} AS value FROM {source}"
                              for c, label in metrics.items())
    return f"{name} AS ({arms})"


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
