import os

from opsmetrics.__main__ import main
from opsmetrics.plans import fixtures as fx
from tests.conftest import SF_SMALL


def test_cli_dashboard_and_upload(spark, tmpdir_path, capsys):
    ops_path = f"{tmpdir_path}/ops"
    fx.operations(spark, SF_SMALL).write.parquet(ops_path)
    out = f"{tmpdir_path}/views"
    main(["dashboard", "--operations", ops_path, "--out", out, "--years", "1996", "--views", "allocation_guide,level_counts"])
    assert spark.read.parquet(f"{out}/level_counts").count() == 3
    assert spark.read.parquet(f"{out}/allocation_guide").count() > 0

    upload = f"{tmpdir_path}/upload.csv"
    with open(upload, "w") as fh:
        fh.write("File,Tipo,Operativo,Estado,Fecha File\n")
        fh.write("F000000001,A,op1,abierto,2024-01-02\n")  # already stored (order key 1)
        fh.write("NEW-1,A,op1,abierto,2024-01-02\n")
        fh.write("NEW-1,A,op2,abierto,2024-01-03\n")
    main(["upload", "--upload", upload, "--stored", ops_path, "--out", f"{tmpdir_path}/up", "--append"])
    printed = capsys.readouterr().out
    assert "'nuevos': 1" in printed and "'existentes': 1" in printed and "'insertados': 1" in printed
    assert spark.read.parquet(ops_path).where("file = 'NEW-1'").count() == 1
    assert os.path.isdir(f"{tmpdir_path}/up/calidad")
