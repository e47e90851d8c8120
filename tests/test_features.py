import pytest

from holdfast.config import FEATURE_COLUMNS
from holdfast.operators import cleaning, features
from tests.conftest import by_id


@pytest.fixture
def table(learners):
    return cleaning.clean(learners(
        {}, {"Number_of_Absences": "10", "Number_of_Failures": "1", "Age": "18"},
        {"Number_of_Absences": "9", "Going_Out": "5", "Weekend_Alcohol_Consumption": "5",
         "Wants_Higher_Education": "no"},
    ))


def test_all_features_in_order(table):
    built = features.build_feature_set(table)
    assert tuple(built.columns) == (*table.columns, *FEATURE_COLUMNS)
    assert built.where("combined_risk_score IS NULL").count() == 0


def test_formulas(table):
    rows = by_id(features.build_feature_set(table))
    assert rows[1].academic_performance_score == pytest.approx(12 * .25 + 13 * .35 + 14 * .4, abs=.01)
    assert rows[1].grade_progression == 1.0
    assert rows[1].alcohol_risk_score == pytest.approx(1 * .6 + 2 * .4)
    assert rows[1].family_support_score == 4 * .5 + 2.0
    assert rows[1].engagement_score == pytest.approx(2 * .4 + 1.5 + .5 + .5)
    assert rows[1].parental_education_level == 3.0
    assert [rows[i].absence_risk_flag for i in (1, 2, 3)] == [0, 1, 0]
    assert [rows[i].failure_history_flag for i in (1, 2, 3)] == [0, 1, 0]
    assert [rows[i].social_risk_index for i in (1, 2, 3)] == [0.0, 0.0, 1.0]
    performance = 1 - rows[2].academic_performance_score / 20
    assert rows[2].combined_risk_score == pytest.approx(performance * .35 + .2 + .15, abs=.001)


def test_constant_social_columns_give_null(learners):
    rows = by_id(features.build_feature_set(cleaning.clean(learners({}, {"Age": "18"}))))
    assert {r.social_risk_index for r in rows.values()} == {None}
    assert {r.combined_risk_score for r in rows.values()} == {None}


def test_absent_support_columns_count_as_zero(table):
    reduced = table.drop("Family_Support", "School_Support", "Internet_Access")
    row = by_id(features.build_feature_set(reduced))[1]
    assert row.family_support_score == 2.0
    assert row.engagement_score == pytest.approx(.8 + 1.5 + .5)


def test_given_extremes_are_used(table):
    stats = features.FeatureStats(0.0, 10.0, 5.0)
    row = by_id(features.build_feature_set(table, stats))[1]
    assert row.social_risk_index == pytest.approx((3 * .4 + 1.4 * .4 + 3 * .2) / 10, abs=.001)


def test_building_twice_replaces_features(table):
    once = features.build_feature_set(table)
    assert features.build_feature_set(once).columns == once.columns


def test_features_need_no_shuffle(table):
    stats = features.fit_features(table)
    plan = features.apply_features(table, stats)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
