import json

import pytest

from textloom import __main__ as command


def test_from_files_to_a_graph(spark, tmp_path, capsys):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("The dasein is being. Dasein meets worldhood. We see dasein and worldhood here.")
    (tmp_path / "texts" / "b.txt").write_text("Worldhood and dasein again. Some worldhood.")
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "c.txt").write_text("The man is here. We see some and we see again.")
    base = str(tmp_path / "store")
    for arguments in (["ingest", str(tmp_path / "texts"), "author"], ["ingest", str(tmp_path / "plain"), "background"], ["rarities", "author", "background", "found", "--method", "ratio", "--top-n", "2"]):
        command.main([base, *arguments], spark)
    assert "dasein" in capsys.readouterr().out
    command.main([base, "search", "author", "worldhood", "--width", "20"], spark)
    assert capsys.readouterr().out.count("[") == 4
    command.main([base, "graph", "author", "found", "net"], spark)
    command.main([base, "analyze", "net"], spark)
    command.main([base, "export", "net", str(tmp_path / "net.json")], spark)
    made = json.loads((tmp_path / "net.json").read_text())
    assert [n["id"] for n in made["nodes"]] == ["dasein", "worldhood"] and len(made["links"]) == 1 and made["links"][0]["weight"] >= 3
    with pytest.raises(SystemExit):
        command.main([base, "export", "net", "x", "--format", "xls"], spark)
