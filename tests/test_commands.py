import json

import pytest

from gramweave.plans import commands
from gramweave.plans.inputs import supplier_distances, supplier_operators, supplier_spectra, suppliers, surrogate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name, df in (("distances", supplier_distances(spark, SF)), ("spectra", supplier_spectra(spark, SF)), ("subjects", suppliers(spark, SF)), ("oof", surrogate(spark, SF)), ("operators", supplier_operators(spark, SF))):
        df.write.parquet(f"{root}/{name}")
    return root


def test_every_command(spark, tables, tmp_path, capsys):
    t = lambda name: [f"--{name}", f"{tables}/{name}"]
    grid = ["--p", "1", "1.5", "2", "4", "16"]
    spectral = commands.execute(spark, ["spectral", *t("spectra"), *t("subjects"), *grid, "--resamples", "4", "--output", f"{tmp_path}/spectral"])["spectral"]
    assert spectral.count() == 5 and "leading_share_ci95_low" in spectral.columns
    assert commands.execute(spark, ["decision", *t("oof")])["decision"].count() == 5
    assert commands.execute(spark, ["propagation", *t("distances"), *t("oof")])["propagation"].count() == 5
    assert commands.execute(spark, ["uncertainty", *t("distances"), "--draws", "5"])["uncertainty"].count() == 5
    made = commands.execute(spark, ["deformation", *t("distances"), "--output", f"{tmp_path}/deformation"])["deformation"]
    assert spark.read.parquet(f"{tmp_path}/deformation").count() == made.count() == 5
    same = commands.execute(spark, ["compare", "--new", f"{tmp_path}/deformation", "--old", f"{tmp_path}/deformation"])["compare"]
    assert all(r.all_close and r.same_grid for r in same.collect())
    lines = [x for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(lines) >= 25 and all(json.loads(x) for x in lines)


def test_pipeline_from_stored_spectra(spark, tables, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"dataset": {"name": "x"}, "science": {"p_values": [1, 2]}, "cv": {"outer_folds": 2, "repeats": 1, "inner_folds": 2}, "model": {"gamma_values": [1], "C_values": [1]}, "spectral": {"n_resamples": 3}, "pipeline": {"stages": ["spectral"]}}))
    made = commands.execute(spark, ["pipeline", "--config", f"{tmp_path}/c.json", "--spectra", f"{tables}/spectra", "--subjects", f"{tables}/subjects", "--output", f"{tmp_path}/out"])
    assert made["spectral"].count() == 2


def test_unknown_commands_end_with_an_error():
    with pytest.raises(SystemExit):
        commands.parser().parse_args(["nothing"])


def test_selection_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(commands, "PRINTED", 4)
    from gramweave.plans.inputs import event_series, supplier_matrices, token_counts

    counts, cells = token_counts(spark, SF)
    for name, df in (("counts", counts), ("cells", cells), ("series", event_series(spark, SF)), ("matrices", supplier_matrices(spark, SF)), ("d", supplier_distances(spark, SF))):
        df.write.parquet(f"{tmp_path}/{name}")
    support = [(p, 1, 1, s, 0.5 * (s + p)) for p in (1.0, 2.0) for s in range(4) if (s + p) % 3]
    spark.createDataFrame(support, "p double, repeat int, fold int, sv long, alpha double").write.parquet(f"{tmp_path}/support")
    run = lambda *a: commands.execute(spark, list(a))[a[0]]
    genes = run("genes", "--counts", f"{tmp_path}/counts", "--cells", f"{tmp_path}/cells")
    assert {"variance", "fano"} <= {r.method for r in genes.select("method").distinct().collect()}
    ranks = sorted(r["rank"] for r in run("sensors", "--series", f"{tmp_path}/series").collect())
    assert ranks and ranks == list(range(1, len(ranks) + 1))
    swept = run("sweep", "--operators", f"{tmp_path}/matrices", "--sizes", "2", "3", "--text", f"{tmp_path}/recommendation")
    assert swept.count() == 2 and spark.read.text(f"{tmp_path}/recommendation").where("value like 'recommended: %'").count() == 2
    same = run("preservation", "--candidate", f"{tmp_path}/d", "--full", f"{tmp_path}/d").collect()
    assert len(same) == 5 and all(r.spearman == pytest.approx(1) for r in same)
    assert run("mechanism", "--support", f"{tmp_path}/support").count() == 2
    assert f"genes\n{genes.count()} rows" in capsys.readouterr().out


def test_reports_and_manifest(spark, tables, tmp_path, capsys):
    summary = f"{tmp_path}/summary"
    commands.execute(spark, ["spectral", "--spectra", f"{tables}/spectra", "--subjects", f"{tables}/subjects", "--p", "1", "16", "--resamples", "3", "--output", summary])
    commands.execute(spark, ["threshold", "--summary", summary, "--level", "0.6", "--text", f"{tmp_path}/threshold"])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/threshold").collect()]
    assert [x.partition(":")[0] for x in lines] == ["p_first", "p_below", "share_at_first"]
    (tmp_path / "c.json").write_text(json.dumps({"dataset": {"name": "x"}, "science": {"p_values": [1, 2]}, "cv": {"outer_folds": 2, "repeats": 1, "inner_folds": 2}, "model": {"gamma_values": [1], "C_values": [1]}, "spectral": {"n_resamples": 3}, "pipeline": {"stages": ["spectral"]}}))
    commands.execute(spark, ["pipeline", "--config", f"{tmp_path}/c.json", "--spectra", f"{tables}/spectra", "--subjects", f"{tables}/subjects", "--output", f"{tmp_path}/out"])
    (folder,) = (tmp_path / "out").glob("x-*/manifest")
    row = spark.read.json(str(folder)).first()
    assert (row.dataset, row.stage, row.rows) == ("x", "spectral", 2) and folder.parent.name == f"x-{row.key}"
