from weftspark.cli import main
from weftspark.shell import Shell, names


def test_cli(spark, capsys):
    assert main(["count", "1000"]) == 0
    assert "most popular is" in capsys.readouterr().out
    assert main(["http", "40"]) == 0
    assert "completed in" in capsys.readouterr().out


def test_shell_joins_continued_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1\n2\n")
    shell = Shell(spark)
    assert shell.push("a = 1 + \\")
    assert not shell.push("2")
    assert shell.locals["a"] == 3
    shell.push(f"b = lines({str(tmp_path / 'x.txt')!r}).map('cast(value AS bigint)').reduce('sum')")
    assert shell.locals["b"] == 3
    assert {"spark", "lines", "objects"} <= set(names(spark))
