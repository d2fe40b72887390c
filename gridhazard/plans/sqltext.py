"""Pieces of ANSI SQL text shared by the equivalent queries."""

from gridhazard.functions import scalar as S


def num(x: float) -> str:
    s = repr(float(x))
    return s if "e" in s else s + "e0"


def horner(x: str, coeffs) -> str:
    out = num(coeffs[0])
    for c in coeffs[1:]:
        out = f"({out} * {x} + {num(c)})"
    return out


def norm_cdf(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-({x}) * ({x}) / 2e0)"
    core = f"{e} * {horner(a, S.PHI_NUM)} / {horner(a, S.PHI_DEN)}"
    frac = f"({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0)))))"
    tail = f"{e} / {frac} / {num(S.PHI_TAIL)}"
    lower = (
        f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < {num(S.PHI_SPLIT)} THEN {core} ELSE {tail} END)"
    )
    return f"(CASE WHEN {x} > 0 THEN 1e0 - {lower} ELSE {lower} END)"


def probit(p: str) -> str:
    q = f"(({p}) - 0.5e0)"
    r0 = f"(0.180625e0 - {q} * {q})"
    centre = f"{q} * {horner(r0, S.PROBIT_A)} / {horner(r0, S.PROBIT_B)}"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1e0 - ({p}) END))"
    near = f"{horner(f'({r} - 1.6e0)', S.PROBIT_C)} / {horner(f'({r} - 1.6e0)', S.PROBIT_D)}"
    far = f"{horner(f'({r} - 5e0)', S.PROBIT_E)} / {horner(f'({r} - 5e0)', S.PROBIT_F)}"
    return (
        f"(CASE WHEN abs({q}) <= 0.425e0 THEN {centre} ELSE sign({q}) * "
        f"(CASE WHEN {r} <= 5e0 THEN {near} ELSE {far} END) END)"
    )


def uniform(seed: int, *exprs: str, part: int = 0) -> str:
    keys = ", ".join(f"({e})::VARCHAR" for e in exprs)
    return (
        f"(('0x' || substr(md5(concat_ws('|', '{seed}', {keys})), {1 + 13 * part}, 13))::BIGINT"
        f" / 4503599627370496e0)"
    )


def hour(ts: str) -> str:
    return f"CAST(floor(epoch({ts}) / 3600) AS BIGINT)"


def stamp(h: str) -> str:
    return f"strftime(make_timestamp(CAST(({h}) AS BIGINT) * 3600000000), '%Y-%m-%d %H:%M:%S')"


def haversine(lat1, lon1, lat2, lon2) -> str:
    a = (
        f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    )
    return f"(6371e0 * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"
