"""Text blocks shared by the checks."""


def r(expression: str, digits: int = 2) -> str:
    """Round half away from zero on fifteen decimals."""
    return f"CAST(round(CAST(({expression}) AS DECIMAL(38,15)), {digits}) AS DOUBLE)"


def ratio(numerator: str, denominator: str, digits: int = 2) -> str:
    """A quotient of exact decimals rounded half away from zero by whole numbers.

    Both sides count millionths; null for a zero denominator.
    """
    n, d = (f"CAST(CAST({x} AS DECIMAL(30,6)) * 1000000 AS HUGEINT)" for x in (numerator, denominator))
    whole = f"(2 * abs({n}) * {10**digits} + abs({d})) // NULLIF(2 * abs({d}), 0)"
    return f"(CAST(sign({n}) * sign({d}) * ({whole}) AS DOUBLE) / {10**digits})"


def exact_mean(column: str, digits: int = 2) -> str:
    """The average of a column of decimals or whole numbers, rounded exactly."""
    return ratio(f"SUM({column})", f"COUNT({column})", digits)


def re(expression: str, digits: int = 2) -> str:
    """Round half to even on fifteen decimals."""
    return f"CAST(round_even(CAST(({expression}) AS DECIMAL(38,15)), {digits}) AS DOUBLE)"


def d(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def mean(expression: str) -> str:
    """Average as the quotient of an exact decimal sum."""
    return f"(CAST(SUM({expression}) AS DOUBLE) / NULLIF(COUNT({expression}), 0))"


def normal_cdf(z: str) -> str:
    """Cumulative normal probability by Simpson's rule over [0, z]."""
    return f"""(0.5 + (SELECT SUM(
        CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * exp(-0.5 * pow(({z}) * i / 2000.0, 2)))
        * ({z}) / 2000.0 / 3 / sqrt(2 * pi()) FROM range(0, 2001) simpson(i)))"""


def student_cdf(t: str, df: str) -> str:
    """Cumulative Student probability by Simpson's rule over [0, t]."""
    return f"""(0.5 + (SELECT SUM(
        CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * pow(1 + pow(({t}) * i / 4000.0, 2) / ({df}), -(({df}) + 1) / 2.0))
        * ({t}) / 4000.0 / 3
        * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())
        FROM range(0, 4001) simpson(i)))"""


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)
