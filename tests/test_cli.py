from ravelin.__main__ import main


def test_cli(spark, data, tmp_path, capsys):
    assert main(["list"]) == 0 and "cooc" in capsys.readouterr().out.split()
    assert main(["run", "sssd_init", data, str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    assert main(["run", "none", data]) == 2
