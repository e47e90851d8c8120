from concurrent.futures import ThreadPoolExecutor

import pytest

from holdfast.ledger import Ledger, claim
from holdfast.operators import models, registry
from holdfast.workspace import new_path


def test_entries(spark):
    ledger = Ledger(spark, new_path(spark, "ledger"))
    assert ledger.names() == [] and ledger.get("one") is None
    ledger.put("one", {"a": 1, "text": "é\n", "none": None})
    ledger.put("two", {})
    ledger.put("one", {"a": 2, "text": "é\n", "none": None})
    assert ledger.names() == ["one", "two"]
    assert ledger.get("one") == {"a": 2, "text": "é\n", "none": None}


def test_one_writer_gets_a_claim(spark):
    path = new_path(spark, "claims") + "/1"
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda _: claim(spark, path), range(8))) == 1


def test_writers_at_once_get_versions_of_their_own(spark):
    folder = new_path(spark, "registry")
    runs = [
        models.Run("baseline_majority", models.majority_model(0), {"accuracy": k / 10}, f"run-{k}", {"kind": "majority"}, None)
        for k in range(4)
    ]
    with ThreadPoolExecutor(4) as pool:
        entries = list(pool.map(lambda run: registry.register_model(spark, folder, run), runs))
    assert sorted(e["version"] for e in entries) == [1, 2, 3, 4]
    rows = registry.registry_table(spark, folder).collect()
    assert [r["version"] for r in rows if r["stage"] == "Production"] == [4]
    assert {r["version"]: r["run_id"] for r in rows} == {e["version"]: e["run_id"] for e in entries}
    assert all(r["description"] == f"majority(): accuracy={r['accuracy']:.4f}" for r in rows)


def test_a_claim_without_a_record_is_no_version(spark):
    """A writer that was lost after its claim."""
    folder = new_path(spark, "registry")
    claim(spark, f"{folder}/claims/{registry.REGISTRY_NAME}/1")
    with pytest.raises(LookupError):
        registry.production_model(spark, folder)
    run = models.Run("baseline_majority", models.majority_model(1), {}, "run", {"kind": "majority"}, None)
    assert registry.register_model(spark, folder, run)["version"] == 2
    assert registry.version_record(spark, folder)["run_id"] == "run"
    with pytest.raises(LookupError, match="without fitted state"):
        registry.production_state(spark, folder)
