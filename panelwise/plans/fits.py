"""SQL twins of fits: Newton's method as a recursive query, and sandwich covariances."""

from __future__ import annotations

from collections.abc import Sequence


def _minor(rows: Sequence[int], cols: Sequence[int]) -> str:
    """The determinant of the information's sub-matrix, by its first row."""
    if not rows:
        return "1.0"
    first, rest = rows[0], rows[1:]
    parts = []
    for k, c in enumerate(cols):
        sign = "-" if k % 2 else "+"
        parts.append(f"{sign} h{min(first, c)}{max(first, c)} * ({_minor(rest, [x for x in cols if x != c])})")
    return " ".join(parts)


def inverse(p: int, i: int, j: int) -> str:
    """Entry (i, j) of the inverse of the symmetric p x p matrix of columns h00, h01, ..."""
    rest = lambda k: [x for x in range(p) if x != k]
    return f"({'-' if (i + j) % 2 else ''}({_minor(rest(i), rest(j))}) / ({_minor(range(p), range(p))}))"


def _sums(p: int) -> str:
    h = [f"sum(w * m * (1 - m) * x{i} * x{j}) AS h{i}{j}" for i in range(p) for j in range(i, p)]
    return ", ".join(h + [f"sum(w * (y - m) * x{i}) AS g{i}" for i in range(p)])


def _data(data: str, x: Sequence[str], y: str, weight: str, keys: Sequence[str] = ()) -> str:
    cols = [*keys, *[f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(x)], f"CAST({y} AS DOUBLE) AS y", f"CAST({weight} AS DOUBLE) AS w"]
    return f"SELECT {', '.join(cols)} FROM {data}"


def newton_sql(data: str, x: Sequence[str], y: str, weight: str = "1", by: str = "", steps: int = 14) -> str:
    """One row (for each value of ``by``) with the coefficients b0, b1, ... of a weighted logistic fit."""
    p, key = len(x), [by] if by else []
    b = [f"b{i}" for i in range(p)]
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    step = ", ".join(f"b{i} + " + " + ".join(f"{inverse(p, i, j)} * g{j}" for j in range(p)) for i in range(p))
    start = f"SELECT DISTINCT 0 AS i, {''.join(k + ', ' for k in key)}{', '.join(f'CAST(0 AS DOUBLE) AS {c}' for c in b)} FROM d"
    met = f"n JOIN d USING ({by})" if by else "n, d"
    cols = ", ".join(["i", *key, *b])
    return f"""WITH RECURSIVE d AS MATERIALIZED ({_data(data, x, y, weight, key)}), n AS ({start} UNION ALL
 SELECT i + 1, {''.join(k + ', ' for k in key)}{step} FROM (SELECT {cols}, {_sums(p)} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS m FROM {met}) GROUP BY {cols}) WHERE i < {steps})
SELECT {', '.join([*key, *b])} FROM n WHERE i = {steps}"""


def covariance_sql(data: str, x: Sequence[str], y: str, fit: str, cluster: str, weight: str = "1") -> str:
    """One row: coefficients b0.., inverse information v00.. and cluster-robust covariance r00.. of a fit."""
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    v = lambda i, j: f"v{min(i, j)}{max(i, j)}"
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    robust = ", ".join(" + ".join(f"{v(i, k)} * {m(k, q)} * {v(q, j)}" for k in range(p) for q in range(p)) + f" AS r{i}{j}" for i, j in pairs)
    return f"""WITH d AS (SELECT *, 1 / (1 + exp(-({eta}))) AS m FROM ({_data(data, x, y, weight, [cluster])}), {fit}),
bread AS (SELECT {', '.join(f'{inverse(p, i, j)} AS v{i}{j}' for i, j in pairs)} FROM (SELECT {_sums(p)} FROM d)),
meat AS (SELECT {', '.join(f'sum(s{i} * s{j}) AS m{i}{j}' for i, j in pairs)} FROM (SELECT {', '.join(f'sum(w * (y - m) * x{i}) AS s{i}' for i in range(p))} FROM d GROUP BY {cluster}))
SELECT fit.*, bread.*, {robust} FROM {fit} fit, bread, meat"""


def conditional_sql(data: str, x: str, ridge: float = 0.0, steps: int = 25) -> str:
    """One row ``b, h``: the coefficient of a (ridge) conditional logit over set_id, is_case and one covariate, and its information."""
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT set_id, is_case, CAST({x} AS DOUBLE) AS x FROM {data} QUALIFY count_if(is_case) OVER (PARTITION BY set_id) = 1 AND count(*) OVER (PARTITION BY set_id) > 1),
n AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS h UNION ALL
 SELECT i + 1, b + CASE WHEN i < {steps} THEN greatest(-1, least(1, (sum(g) - {ridge} * b) / (sum(v) + {ridge}))) ELSE 0 END, sum(v) + {ridge}
 FROM (SELECT i, b, max(CASE WHEN is_case THEN x END) - sum(x * e) / sum(e) AS g, sum(x * x * e) / sum(e) - pow(sum(x * e) / sum(e), 2) AS v FROM (SELECT *, exp(b * x) AS e FROM n, d) GROUP BY i, b, set_id) WHERE i <= {steps} GROUP BY i, b)
SELECT b, h FROM n WHERE i = {steps + 1}"""


#: Poisson multiplicities of the bootstrap: a draw is the number of these thresholds, in order, that the first
#: eight hexadecimal digits of an MD5 exceed.
def thresholds() -> list[str]:
    from math import exp

    total, term, out = 0.0, exp(-1.0), []
    for k in range(8):
        total += term
        term /= k + 1
        out.append(f"{min(int(total * 2**32), 2**32 - 1):08x}")
    return out


def multiplicity_sql(b: str, unit: str, seed: int = 1) -> str:
    drawn = f"substr(md5(concat_ws('|', {b}, {unit}, {seed})), 1, 8)"
    return " + ".join(f"CAST({drawn} > '{t}' AS INTEGER)" for t in thresholds())


def matched_sql(data: str, x: Sequence[str], ridge: float, steps: int = 20, person: str = "") -> str:
    """One row of a ridge conditional logit over set_id, is_case and several covariates: b0.., the inverse
    information v00.., the set-robust covariance r00.. and, if a person is named, the person-robust one p00..."""
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    b = ", ".join(f"b{i}" for i in range(p))
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    per_set = [f"max(CASE WHEN is_case THEN x{i} END) - sum(x{i} * e) / sum(e) AS g{i}" for i in range(p)] + [f"sum(x{i} * x{j} * e) / sum(e) - sum(x{i} * e) * sum(x{j} * e) / (sum(e) * sum(e)) AS h{i}{j}" for i, j in pairs]
    total = [f"sum(g{i}) - {ridge} * b{i} AS g{i}" for i in range(p)] + [f"sum(h{i}{j})" + (f" + {ridge}" if i == j else "") + f" AS h{i}{j}" for i, j in pairs] + [f"sum(g{i} * g{j}) AS m{i}{j}" for i, j in pairs]
    v = lambda i, j: inverse(p, i, j)
    m = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    step = ", ".join(f"b{i} + " + " + ".join(f"{v(i, j)} * g{j}" for j in range(p)) + f" AS b{i}" for i in range(p))
    sums = f"SELECT i, {b}, {', '.join(total)} FROM (SELECT i, {b}, set_id, {', '.join(per_set)} FROM (SELECT *, exp({eta}) AS e FROM n, d) GROUP BY i, {b}, set_id) GROUP BY i, {b}"
    last = f"SELECT {b}, {', '.join(total)} FROM (SELECT {b}, set_id, {', '.join(per_set)} FROM (SELECT *, exp({eta}) AS e FROM n, d WHERE i = {steps}) GROUP BY {b}, set_id) GROUP BY {b}"
    robust = ", ".join(" + ".join(f"{v(i, k)} * {m(k, q)} * {v(q, j)}" for k in range(p) for q in range(p)) + f" AS r{i}{j}" for i, j in pairs)
    who = f"{person}, " if person else ""
    clustered, tail = "", f"FROM ({last})"
    if person:
        score = ", ".join(f"sum((CAST(is_case AS INTEGER) - e / total) * x{i}) AS u{i}" for i in range(p))
        scored = f"SELECT {score} FROM (SELECT d.*, exp({eta}) AS e, sum(exp({eta})) OVER (PARTITION BY set_id) AS total FROM n, d WHERE i = {steps}) GROUP BY {person}"
        q = lambda i, j: f"q{min(i, j)}{max(i, j)}"
        tail = f"FROM ({last}), (SELECT {', '.join(f'sum(u{i} * u{j}) AS q{i}{j}' for i, j in pairs)} FROM ({scored}))"
        clustered = ", " + ", ".join(" + ".join(f"{v(i, k)} * {q(k, t)} * {v(t, j)}" for k in range(p) for t in range(p)) + f" AS p{i}{j}" for i, j in pairs)
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT set_id, {who}is_case, {', '.join(f'CAST({c} AS DOUBLE) AS x{i}' for i, c in enumerate(x))} FROM {data} QUALIFY count_if(is_case) OVER (PARTITION BY set_id) = 1 AND count(*) OVER (PARTITION BY set_id) > 1),
n AS (SELECT 0 AS i, {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in range(p))} UNION ALL SELECT i + 1, {step} FROM ({sums}) WHERE i < {steps})
SELECT {b}, {', '.join(f'{v(i, j)} AS v{i}{j}' for i, j in pairs)}, {robust}{clustered} {tail}"""


def resampled_sql(data: str, x: Sequence[str], ridge: float, reps: str, person: str, steps: int = 25) -> str:
    """Rows ``b, b0..``: the ridge conditional logit in every resample of ``reps`` (unit, b, k), whose multiplicities weight the
    members of sets that keep their identity. Resamples without an informative set have no row."""
    p = len(x)
    b = ", ".join(f"b{i}" for i in range(p))
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    per_set = ["sum(k * y) AS c", "sum(k * e) AS s"] + [f"sum(k * y * x{i}) AS cx{i}" for i in range(p)] + [f"sum(k * e * x{i}) / sum(k * e) AS s{i}" for i in range(p)] + [f"sum(k * e * x{i} * x{j}) / sum(k * e) AS s{i}{j}" for i, j in pairs]
    total = [f"sum(cx{i} - c * s{i}) - {ridge} * b{i} AS g{i}" for i in range(p)] + [f"sum(c * (s{i}{j} - s{i} * s{j}))" + (f" + {ridge}" if i == j else "") + f" AS h{i}{j}" for i, j in pairs]
    step = ", ".join(f"b{i} + " + " + ".join(f"{inverse(p, i, j)} * g{j}" for j in range(p)) + f" AS b{i}" for i in range(p))
    sums = f"SELECT i, b, {b}, {', '.join(total)} FROM (SELECT i, b, {b}, set_id, {', '.join(per_set)} FROM (SELECT n.*, d.* EXCLUDE (b), exp({eta}) AS e FROM n JOIN d USING (b)) GROUP BY i, b, {b}, set_id) WHERE c > 0 GROUP BY i, b, {b}"
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT r.b, r.k, m.set_id, CAST(m.is_case AS INTEGER) AS y, {', '.join(f'CAST(m.{c} AS DOUBLE) AS x{i}' for i, c in enumerate(x))}
 FROM (SELECT * FROM {data} QUALIFY count_if(is_case) OVER (PARTITION BY set_id) = 1 AND count(*) OVER (PARTITION BY set_id) > 1) m JOIN {reps} r ON r.unit = m.{person} WHERE r.k > 0),
n AS (SELECT DISTINCT 0 AS i, b, {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in range(p))} FROM d UNION ALL SELECT i + 1, b, {step} FROM ({sums}) WHERE i < {steps})
SELECT b, {b} FROM n WHERE i = {steps}"""
