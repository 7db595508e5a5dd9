from lattica.cli import Shell, shown, statements
from lattica.graph import PropertyGraph
from lattica.session import GraphSession


def test_modes_and_commands(spark, capsys, tmp_path):
    shell = Shell(GraphSession(PropertyGraph(spark)), "csv", False)
    assert shell.run("CREATE (:P {name: 'A', k: 1})") and shell.run("MATCH (p:P) RETURN p.name AS n, p.k AS k")
    assert "n,k\r\nA,1" in capsys.readouterr().out
    for line in (".mode line", ".timer off", ".tables", ".stats", ".export", ".help", f".save {tmp_path}/g"):
        assert shell.command(line)
    text = capsys.readouterr().out
    assert "1 nodes, 0 relationships" in text and "CREATE (_0:P {k: 1, name: 'A'})" in text and "P\n" in text
    assert shell.run("MATCH (p:P) RETURN p.k AS k") and "k = 1" in capsys.readouterr().out
    assert not shell.run("MATCH (") and "ParseError" in capsys.readouterr().err
    assert statements("RETURN 'a;b' AS x; // c\nRETURN 2;") == ["RETURN 'a;b' AS x", " // c\nRETURN 2"]
    assert not shell.command(".quit")
    assert shown(shell.session.cypher("RETURN 1 AS x"), "json") == 1 and '{"x":1}' in capsys.readouterr().out
