"""Recurrences over the years of a key, folded in the JVM: cash sweep, depreciation by class, three statements.

A key's years are one short array, as long as there are years; the fold goes over it with a
struct as its state. Keys are dealt like any group, nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def over_years(df: DataFrame, keys: Sequence[str], year: str, start: Column, state: str, step: Callable[[Column, Column], Column]) -> DataFrame:
    """The keys, the year and the state after it, a row a year, in the order of the years.

    state is the DDL of a struct, start its value before the first year, step(state, row) its
    value after a row. Rows that repeat a year follow each other, by the order of their columns.
    """
    columns = [c for c in df.columns if c not in keys and c != year]
    kind = df.schema[year].dataType.simpleString()
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(year, *columns))).alias("_rows"))

    def after(a: Column, x: Column) -> Column:
        return let(step(a["state"], x).cast(state), lambda s: F.struct(s.alias("state"), F.concat(a["seen"], F.array(F.struct(x[year].alias(year), s.alias("state")))).alias("seen")))

    begin = F.struct(start.cast(state).alias("state"), F.array().cast(f"array<struct<`{year}`: {kind}, state: {state}>>").alias("seen"))
    # outer: no key is without years, and Spark would fold twice to drop such keys
    return rows.select(*keys, F.inline_outer(F.aggregate("_rows", begin, after)["seen"])).select(*keys, year, "state.*")


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def revolver_move(before: Column, minimum: Column, owed: Column) -> Column:
    """What is drawn to reach the minimum, or, negative, paid back of what is owed out of what is above it."""
    return let(F.greatest(F.lit(0.0), minimum - before), lambda gap: F.when(gap > 0, gap).otherwise(-F.least(owed, F.greatest(F.lit(0.0), before - minimum))))


def cash_sweep(df: DataFrame, keys: Sequence[str], year: str, flow: str, opening: float, minimum: float) -> DataFrame:
    """Revolver: a gap below the minimum is drawn, a surplus pays back what is owed: draw, debt, cash."""

    def step(s: Column, x: Column) -> Column:
        before = s["cash"] + x[flow]
        return let(revolver_move(before, F.lit(float(minimum)), s["debt"]), lambda m: F.struct(m.alias("draw"), (s["debt"] + m).alias("debt"), (before + m).alias("cash")))

    start = F.struct(F.lit(0.0).alias("draw"), F.lit(0.0).alias("debt"), F.lit(float(opening)).alias("cash"))
    return over_years(df.select(*keys, year, F.col(flow).cast("double")), keys, year, start, "struct<draw: double, debt: double, cash: double>", step)


def depreciation(opening: Column, capex: Column, life: Column) -> Column:
    """Of the opening balance over the life, and half a year's of what came in; none without a life."""
    return F.when(life > 0, opening / life + capex / life / 2).otherwise(0.0)


def by_class(amount: Column, opening: Column) -> Column:
    """The amount split by the classes' opening balances; the last class takes the rest.

    So the parts add up to the amount whatever the balances are, zero included.
    """

    def split(v: Column) -> Column:
        first = F.transform(F.slice(v["opening"], F.lit(1), F.greatest(F.lit(0), F.size(v["opening"]) - 1)), lambda b: F.when(v["whole"] != 0, b / v["whole"] * v["amount"]).otherwise(0.0))
        return let(first, lambda f: F.concat(f, F.array(v["amount"] - total(f))))

    return let(F.struct(opening.alias("opening"), total(opening).alias("whole"), amount.alias("amount")), split)


def fixed_assets(df: DataFrame, keys: Sequence[str], year: str, opening: str, capex: str, life: str) -> DataFrame:
    """Roll-forward of classes of fixed assets: depreciation, depreciation_by_class, balances.

    opening (an array, one number a class) counts in the first year of a key.
    """

    def step(s: Column, x: Column) -> Column:
        had = F.when(F.size(s["balances"]) > 0, s["balances"]).otherwise(x[opening])

        def year_of(v: Column) -> Column:
            dep = depreciation(total(v["had"]), total(x[capex]), x[life])
            return let(dep, lambda d: let(by_class(d, v["had"]), lambda parts: F.struct(
                d.alias("depreciation"), parts.alias("depreciation_by_class"), F.zip_with(F.zip_with(v["had"], x[capex], lambda a, b: a + b), parts, lambda a, b: a - b).alias("balances"),
            )))

        return let(F.struct(had.alias("had")), year_of)

    none = F.array().cast("array<double>")
    start = F.struct(F.lit(0.0).alias("depreciation"), none.alias("depreciation_by_class"), none.alias("balances"))
    return over_years(df.select(*keys, year, opening, capex, life), keys, year, start, "struct<depreciation: double, depreciation_by_class: array<double>, balances: array<double>>", step)


#: What a year of the three statements shows and hands to the next one.
SHOWN = (
    "depreciation", "profit", "tax", "operating", "investing", "free", "financing", "draw", "cash", "revolver", "debt", "retained", "restructured",
    "current_assets", "other_assets_total", "current_claims", "other_claims_total", "equity_total", "check",
)
_CARRIED = ("needed", "taxes", "other_assets", "other_claims", "equity", "plug_ca", "plug_oa", "plug_cc", "plug_oc", "plug_eq")
INPUTS = (
    "historical", "ebitda", "tax_rate", "dividends", "working_assets", "working_claims", "fixed", "capex", "life", "debt", "amortised", "amortised_cash", "debt_interest", "issued", "issue_amortised",
    "issue_interest", "short_share", "tax_short", "tax_long", "financial_income", "cash", "minimum_cash", "revolver_rate", "other_assets", "other_claims", "equity",
    "told_current_assets", "told_other_assets", "told_current_claims", "told_other_claims", "told_equity",
)


def three_statements(df: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """Income, cash flow and balance of every year of a key, with the columns SHOWN and the classes' balances in `fixed`.

    df has a row a year with the columns INPUTS. Historical years take cash, fixed assets, debt and
    equity as they are told; what the told total of a group has beyond its lines (0 where it isn't
    told) is the group's plug, and stays as it is in all years to come, as do accounts without an
    assumption. In other years depreciation follows the classes, the revolver draws what cash lacks
    or pays back what is owed, and amortisation without cash goes to equity. Dividends are not
    above 0. check is assets less claims and equity: where the told totals close, it is 0 in every
    later year.
    """
    balances = lambda v: [
        (v["cash"] + v["working_assets"] + v["plug_ca"]).alias("current_assets"), (total(v["fixed"]) + v["other_assets"] + v["plug_oa"]).alias("other_assets_total"),
        (v["working_claims"] + v["debt"] * v["short_share"] + v["revolver"] + v["tax_short"] + v["plug_cc"]).alias("current_claims"),
        (v["debt"] * (1 - v["short_share"]) + v["tax_long"] + v["other_claims"] + v["plug_oc"]).alias("other_claims_total"), (v["equity"] + v["retained"] + v["restructured"] + v["plug_eq"]).alias("equity_total"),
    ]
    state = "struct<" + ", ".join(f"{c}: double" for c in (*SHOWN, *_CARRIED)) + ", fixed: array<double>>"
    year_inputs = ("working_assets", "working_claims", "short_share", "tax_short", "tax_long")

    def closed(x: Column, **values: Column) -> Column:
        """The state of a year from its values, with the balances, their check and what the next year needs."""
        known = F.struct(*(c.alias(k) for k, c in values.items()), *(x[c].alias(c) for c in year_inputs))

        def shown(v: Column) -> Column:
            def whole(b: Column) -> Column:
                check = b["current_assets"] + b["other_assets_total"] - b["current_claims"] - b["other_claims_total"] - b["equity_total"]
                have = {c: b[c] for c in ("current_assets", "other_assets_total", "current_claims", "other_claims_total", "equity_total")} | {"check": check, "needed": x["working_assets"] - x["working_claims"], "taxes": x["tax_short"] + x["tax_long"]}
                return F.struct(*((have[c] if c in have else v[c]).cast("double").alias(c) for c in (*SHOWN, *_CARRIED)), v["fixed"].alias("fixed"))

            return let(F.struct(*balances(v)), whole)

        return let(known, shown)

    def told(x: Column) -> Column:
        zero = F.lit(0.0)
        plug = lambda name, lines: F.coalesce(x[name] - lines, zero)
        return closed(
            x, **dict.fromkeys(("depreciation", "profit", "tax", "operating", "investing", "free", "financing", "draw", "revolver", "retained", "restructured"), zero),
            cash=x["cash"], debt=x["debt"], fixed=x["fixed"], other_assets=x["other_assets"], other_claims=x["other_claims"], equity=x["equity"],
            plug_ca=plug("told_current_assets", x["cash"] + x["working_assets"]), plug_oa=plug("told_other_assets", total(x["fixed"]) + x["other_assets"]),
            plug_cc=plug("told_current_claims", x["working_claims"] + x["debt"] * x["short_share"] + x["tax_short"]),
            plug_oc=plug("told_other_claims", x["debt"] * (1 - x["short_share"]) + x["tax_long"] + x["other_claims"]), plug_eq=plug("told_equity", x["equity"]),
        )

    def projected(s: Column, x: Column) -> Column:
        begun = F.struct(
            depreciation(total(s["fixed"]), total(x["capex"]), x["life"]).alias("dep"), total(x["capex"]).alias("capex"), (s["taxes"] - x["tax_short"] - x["tax_long"]).alias("tax_paid"),
            (x["ebitda"] - x["debt_interest"] - x["issue_interest"] - s["revolver"] * x["revolver_rate"] + x["financial_income"]).alias("before_dep"),
        )

        def earned(a: Column) -> Column:
            pretax = a["before_dep"] - a["dep"]
            tax = F.greatest(F.lit(0.0), pretax) * x["tax_rate"]
            return let(F.struct(tax.alias("tax"), (pretax - tax).alias("profit"), by_class(a["dep"], s["fixed"]).alias("parts")), lambda e: flowed(a, e))

        def flowed(a: Column, e: Column) -> Column:
            operating = e["profit"] + a["dep"] - (x["working_assets"] - x["working_claims"] - s["needed"]) - a["tax_paid"]
            borrowed = x["issued"] - x["amortised_cash"] - x["issue_amortised"] + x["dividends"]
            flows = F.struct(operating.alias("operating"), (operating - a["capex"]).alias("free"), borrowed.alias("borrowed"))
            return let(flows, lambda f: let(revolver_move(s["cash"] + f["free"] + f["borrowed"], x["minimum_cash"], s["revolver"]), lambda draw: ended(a, e, f, draw)))

        def ended(a: Column, e: Column, f: Column, draw: Column) -> Column:
            kept = ("other_assets", "other_claims", "equity", "plug_ca", "plug_oa", "plug_cc", "plug_oc", "plug_eq")
            return closed(
                x, depreciation=a["dep"], profit=e["profit"], tax=e["tax"], operating=f["operating"], investing=-a["capex"], free=f["free"], financing=f["borrowed"] + draw, draw=draw,
                cash=s["cash"] + f["free"] + f["borrowed"] + draw, revolver=s["revolver"] + draw, debt=s["debt"] + x["issued"] - x["amortised"] - x["issue_amortised"],
                retained=s["retained"] + e["profit"] + x["dividends"], restructured=s["restructured"] + x["amortised"] - x["amortised_cash"],
                fixed=F.zip_with(F.zip_with(s["fixed"], x["capex"], lambda p, q: p + q), e["parts"], lambda p, q: p - q), **{c: s[c] for c in kept},
            )

        return let(begun, earned)

    start = F.struct(*(F.lit(0.0).alias(c) for c in (*SHOWN, *_CARRIED)), F.array().cast("array<double>").alias("fixed"))
    out = over_years(df.select(*keys, year, *INPUTS), keys, year, start, state, lambda s, x: F.when(x["historical"], told(x)).otherwise(projected(s, x)))
    return out.select(*keys, year, *SHOWN, "fixed")


def covenants(ebitda: Column, debt: Column, cash: Column, interest: Column, amortised: Column, current_assets: Column, stock: Column, current_claims: Column, equity: Column, most_leverage: float = 3.0, least_cover: float = 1.2, least_liquidity: float = 1.0) -> dict[str, Column]:
    """Ratios of credit by name, null where they mean nothing, and the state of each covenant: ok, broken or none.

    Leverage means nothing without a result, cover without a debt service.
    """
    leverage = F.when(ebitda > 0, (debt - cash) / F.nullif(ebitda, F.lit(0.0)))
    service = interest + amortised
    cover = F.when(service > 0, ebitda / F.nullif(service, F.lit(0.0)))
    liquidity = F.when(current_claims != 0, current_assets / F.nullif(current_claims, F.lit(0.0))).otherwise(0.0)
    tested = lambda ratio, broken: F.when(ratio.isNull(), "none").when(broken, "broken").otherwise("ok")
    return {
        "net_leverage": leverage, "gross_leverage": F.when(ebitda > 0, debt / F.nullif(ebitda, F.lit(0.0))), "service_cover": cover, "interest_cover": F.when(interest > 0, ebitda / F.nullif(interest, F.lit(0.0))),
        "current_ratio": liquidity, "quick_ratio": F.when(current_claims != 0, (current_assets - stock) / F.nullif(current_claims, F.lit(0.0))).otherwise(0.0),
        "debt_to_equity": F.when(equity != 0, debt / F.nullif(equity, F.lit(0.0))),
        "leverage_state": tested(leverage, leverage > most_leverage), "cover_state": tested(cover, cover < least_cover), "liquidity_state": tested(liquidity, liquidity < least_liquidity),
    }


def diagnosis(check: Column, cash: Column, minimum: Column, ebitda: Column, leverage_state: Column) -> Column:
    """The gravest finding of a year: unbalanced, cash_below_minimum, no_result, leverage_broken or ok."""
    return F.when(F.abs(check) > 0.5, "unbalanced").when(cash < minimum, "cash_below_minimum").when(ebitda < 0, "no_result").when(leverage_state == "broken", "leverage_broken").otherwise("ok")
