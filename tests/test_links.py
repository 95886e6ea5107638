"""Links of lines to assumptions: refusals, whole sections, removals."""

from tidemark.operators import links

LINK = "case_id int, section string, label string, entity string, assumption string, seasonality string"
ROLES = [(1, "a", "Receita Líquida", "subtotal"), (1, "a", "Vendas", "conta"), (1, None, "Jan/24", "serie_mensal"), (1, "b", "Vendas", "derivado"), (1, "a", "Fretes", None)]
ACTIVE = [(1, "growth", True), (1, "curve", True), (1, "rate", False), (2, "growth", True)]


def frames(spark):
    return spark.createDataFrame(ROLES, "case_id int, section string, label string, role string"), spark.createDataFrame(ACTIVE, "case_id int, code string, active boolean")


def test_requests_are_refused_for_their_reason(spark):
    roles, active = frames(spark)
    asked = [
        ((1, "a", "VENDAS", None, "growth", "curve"), "linked"),
        ((1, "a", "receita  liquida", None, "growth", None), "not_an_account"),
        ((1, "a", "Receita Líquida", None, None, None), "linked"),
        ((1, None, "jan/24", None, "growth", None), "not_an_account"),
        ((1, "", "jan/24", None, "growth", None), "not_an_account"),
        ((1, "b", "Vendas", None, "growth", None), "not_an_account"),
        ((1, "c", "Vendas", None, "growth", None), "linked"),
        ((1, "a", "Fretes", None, "rate", None), "assumption_inactive"),
        ((1, "a", "Fretes", None, "growth", "rate"), "seasonality_inactive"),
        ((1, "a", "Fretes", None, None, "none"), "seasonality_inactive"),
        ((3, "a", "Fretes", None, "growth", None), "assumption_inactive"),
    ]
    requests = spark.createDataFrame([(*r, k, "ana") for k, (r, _) in enumerate(asked)], LINK + ", at int, author string")
    got = links.outcomes(requests, roles, active)
    assert [r.outcome for r in got.orderBy("at").collect()] == [o for _, o in asked]
    had = spark.createDataFrame([(1, "a", "vendas", "", "rate", None), (1, "z", "vendas", None, "rate", None)], LINK)
    after = sorted(tuple(r) for r in links.after_links(had, got.where("at in (0, 1, 6)")).collect() if r.section != "z")
    assert after == [(1, "a", "vendas", None, "growth", "curve"), (1, "c", "vendas", None, "growth", None)]


def test_the_last_request_of_a_key_stands(spark):
    rows = spark.createDataFrame([(1, "a", "x", None, "growth", None, 1, "ana", "linked"), (1, "a", "x", "", "curve", None, 2, "ana", "linked"), (1, "a", "x", None, "rate", None, 3, "ana", "assumption_inactive")], LINK + ", at int, author string, outcome string")
    got = links.after_links(rows.limit(0).select("case_id", "section", "label", "entity", "assumption", "seasonality"), rows).collect()
    assert [(r.label, r.assumption) for r in got] == [("x", "curve")]


def test_a_section_goes_on_past_lines_of_other_roles(spark):
    roles, active = frames(spark)
    lines = spark.createDataFrame([(1, "a", "Vendas", None), (1, "a", "Fretes", "E1"), (1, "a", "Receita Líquida", None), (1, None, "Jan/24", None), (2, "a", "Vendas", None)], "case_id int, section string, label string, entity string")
    batches = spark.createDataFrame([(1, "a", "growth", None, 1, "ana"), (1, "a", "rate", None, 2, "ana"), (1, None, "growth", "curve", 3, "ana"), (2, "a", "growth", "curve", 4, "ana"), (1, "q", "growth", None, 5, "ana")], "case_id int, section string, assumption string, seasonality string, at int, author string")
    done = links.outcomes(links.of_sections(batches, lines), roles, active)
    got = [(r.outcome, r.n_linked, r.n_passed) for r in links.of_batches(batches, done, active).orderBy("at").collect()]
    assert got == [("applied", 2, 1), ("assumption_inactive", 0, 0), ("applied", 0, 1), ("seasonality_inactive", 0, 0), ("applied", 0, 0)]


def test_removals_take_their_links(spark):
    _, active = frames(spark)
    catalogue = spark.createDataFrame([("growth",), ("curve",), ("rate",)], "code string")
    had = spark.createDataFrame([(1, "a", "x", None, "growth", None), (1, "a", "y", None, "growth", "curve"), (1, "a", "z", None, None, None), (2, "a", "z", None, None, None), (2, "a", "x", None, "growth", None), (1, "a", "w", None, "rate", "growth")], LINK)
    asked = spark.createDataFrame([(1, "growth", "ana"), (1, "rate", "ana"), (1, "none", "ana"), (3, "growth", "ana")], "case_id int, code string, author string")
    out = links.removals(asked, active, catalogue, had)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "growth", "ana", "removed", 2, 1), (1, "none", "ana", "unknown", 0, 0), (1, "rate", "ana", "not_active", 0, 0), (3, "growth", "ana", "not_active", 0, 0)]
    left = sorted((r.case_id, r.label, r.assumption, r.seasonality) for r in links.after_removals(had, out).collect())
    assert left == [(1, "w", "rate", None), (1, "y", None, "curve"), (2, "x", "growth", None), (2, "z", None, None)]
