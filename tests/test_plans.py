"""The research chain and the command line on a small panel."""

import json

import pytest

from fathomline import cli
from fathomline.plans import stages
from fathomline.sources import prices


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("prices") / "p.parquet")
    prices.nav_panel(spark, "/root/testdata/sf0.01").where("code in ('AF', 'RF')").write.parquet(path)
    return path


def test_research_chain(spark, table, tmp_path):
    config = stages.Config().override(output_dir=str(tmp_path), factor_names=("momentum", "drawdown", "price_position", "volatility"), n_trials=4, levels=2, weight_trials=4, position_trials=3, min_ic=-1.0, min_icir=-9.0)
    panel = spark.read.parquet(table)
    kept = stages.research(spark, panel, config, "stability")
    assert set(kept) == {"AF", "RF"} and all(len(v) == 3 for v in kept.values())
    body = json.load(open(kept["AF"][2], encoding="utf-8"))
    assert body["path_code"][3:] == "000" and "0" not in body["path_code"][:3] and body["input_ref"] == kept["AF"][1]
    with pytest.raises(ValueError):
        stages.load_stage(kept["AF"][2], 4)
    # On from the artefacts of a stage: those before it stay as they are.
    on = stages.research(spark, panel, config, "dedup", {"AF": kept["AF"][2]})
    assert on["AF"][:3] == kept["AF"] and len(on["AF"]) == 4
    found = stages.load_stage(on["AF"][3], 3)["dedup_selection_output"]
    assert found["candidate_label_list"] and found["best_final_selection_summary"]["source"] in ("forward", "extension")
    assert len(found["corr_dropped_label_list"]) <= 2
    last = stages.research(spark, panel, config, "strategy-backtest", {"AF": on["AF"][3]})
    with pytest.raises(ValueError):
        cli.run(spark, ["research", "stability", "--prices", table, "--dedup-selection-path", on["AF"][3]])
    assert list(last) == ["AF"] and len(last["AF"]) == 6
    combined = stages.load_stage(last["AF"][4], 4)["factor_combination_output"]["best_combination_selection_summary"]
    assert combined["selected_method"] in ("equal_weight", "train_icir_weighted", "tuned") and abs(sum(combined["candidate_weight_dict"].values()) - 1) < 1e-9


def test_commands(spark, table, tmp_path):
    base = ["--prices", table, "--output-dir", str(tmp_path), "--n-trials", "3"]
    assert cli.run(spark, ["backtest", "single", *base, "--fund-code", "0000AF", "--strategy-name", "ma_cross"]).count() == 1
    assert cli.run(spark, ["backtest", "batch", *base, "--strategy-name", "momentum"]).count() == 2
    for name in ("ma_cross", "momentum", "multi_factor_score"):
        best = cli.run(spark, ["backtest", "optimize", *base, "--strategy-name", name]).where("is_best").collect()
        assert len(best) == 2 and all(r.params for r in best)
    with pytest.raises(SystemExit):
        cli.run(spark, ["backtest", "nothing"])


def test_path_codes_inherit():
    a = stages.path_code(None, 0, {"x": 1})
    b = stages.path_code(a, 1, {"x": 2})
    assert len(b) == 6 and b[0] == a[0] and b[2:] == "0000"
