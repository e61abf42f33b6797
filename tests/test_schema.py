import json

import pytest
from pyspark.sql import types as T

from tableguard import SchemaLoader, SchemaModel, cli, dtypes
from tableguard.schema import ColumnSchema

COLUMNS = {"age": {"dtype": "Int64", "synonyms": ["years"], "nullable": True, "checks": [{"name": "between", "args": {"min": 0, "max": 99}}]}, "name": {"dtype": "Utf8"}}
YAML = """
profile: clean
columns:
  age: {dtype: Int64, synonyms: [years], nullable: true, checks: [{name: between, args: {min: 0, max: 99}}]}
  name: {dtype: Utf8}
"""


def test_defaults():
    s = SchemaModel.from_dict({"columns": {"a": {"dtype": "Int8"}}})
    c = s.columns["a"]
    assert (s.lazy, s.coerce, s.profile, s.frame_parsers, s.frame_checks) == (True, True, "strict", [], [])
    assert (c.required, c.nullable, c.on_failure, c.synonyms, c.parsers, c.checks) == (True, False, None, [], [], [])
    assert repr(s) == "<SchemaModel lazy=True, coerce=True, columns=[a]>"


def test_all_loaders_agree(tmp_path):
    data = {"profile": "clean", "columns": COLUMNS}
    model = SchemaModel.from_dict(data)
    for suffix, text in ((".json", json.dumps(data)), (".yaml", YAML), (".YML", YAML)):
        path = tmp_path / f"s{suffix}"
        path.write_text(text)
        assert SchemaModel.from_file(path) == model
    loader = SchemaLoader()
    assert loader.from_json_str(json.dumps(data)) == loader.from_yaml_str(YAML) == loader.from_mapping(data) == loader.from_python(model) == SchemaModel.from_python(model) == SchemaModel.from_python(data) == model
    assert loader.from_json_file(tmp_path / "s.json") == loader.from_yaml_file(tmp_path / "s.yaml") == model


@pytest.mark.parametrize(
    "data",
    [
        {}, {"columns": {"a": {"dtype": "NotAType"}}}, {"columns": {"a": {"dtype": "col"}}}, {"columns": {"a": {}}}, {"columns": {"a": {"dtype": "Int64", "on_failure": "null"}}}, {"columns": {"a": {"dtype": "Int64", "on_failure": "drop"}}},
        {"columns": {"a": {"dtype": "Int64", "more": 1}}}, {"columns": {}, "more": 1}, {"columns": {"a": {"dtype": "Int64", "checks": [{"name": "x", "arg": 1}]}}}, {"columns": {"a": {"dtype": "Enum"}}}, {"columns": {}, "profile": "loose"},
    ],
)
def test_rejected(data):
    with pytest.raises(ValueError, match="Invalid schema configuration"):
        SchemaModel.from_dict(data)


def test_loader_with_another_model(tmp_path):
    class Own(SchemaModel):
        pass

    assert type(SchemaLoader(Own).from_yaml_str(YAML)) is Own
    with pytest.raises(AttributeError):
        SchemaLoader().from_toml_file


def test_bad_files(tmp_path):
    (tmp_path / "a.json").write_text("{")
    (tmp_path / "a.yaml").write_text("a: [")
    (tmp_path / "b.yaml").write_text("- 1")
    for name in ("a.json", "a.yaml", "b.yaml", "none.json", "a.txt"):
        with pytest.raises(ValueError, match="Invalid schema configuration"):
            SchemaModel.from_file(tmp_path / name)
    with pytest.raises(json.JSONDecodeError):
        SchemaLoader().from_json_file(tmp_path / "a.json")
    with pytest.raises(FileNotFoundError):
        SchemaLoader().from_yaml_file(tmp_path / "none.yaml")


@pytest.mark.parametrize(
    ("profile", "nullable", "own", "result"),
    [
        ("strict", True, None, "raise"), ("strict", False, None, "raise"), ("clean", True, None, "null"), ("clean", False, None, "raise"), ("audit", True, None, "raise"),
        ("strict", True, "null", "null"), ("clean", True, "raise", "raise"), ("audit", True, "null", "null"),
    ],
)
def test_resolve_on_failure(profile, nullable, own, result):
    c = ColumnSchema(dtype="Int64", nullable=nullable, on_failure=own)
    assert SchemaModel(profile=profile, columns={"a": c}).resolve_on_failure("a") == result


def test_yaml_null_inherits():
    s = SchemaModel.from_yaml("profile: clean\ncolumns: {a: {dtype: Int64, nullable: true, on_failure: null}, b: {dtype: Int64, nullable: true, on_failure: 'null'}}")
    assert s.columns["a"].on_failure is None and s.columns["b"].on_failure == "null"


def test_dtypes():
    assert dtypes.resolve("Utf8").spark == dtypes.resolve("String").spark == T.StringType()
    assert dtypes.resolve("Datetime").spark == T.TimestampNTZType() and dtypes.resolve("UInt8").high == 255
    for name in ("Time", "Object", "int", "", None):
        with pytest.raises(ValueError):
            dtypes.resolve(name)


def test_cli(tmp_path, capsys):
    (tmp_path / "s.yaml").write_text(YAML)
    cli.main([str(tmp_path / "s.yaml")])
    assert json.loads(capsys.readouterr().out)["columns"]["age"]["synonyms"] == ["years"]
    for given in ([str(tmp_path / "s.toml")], [str(tmp_path / "none.json")], [], ["-h"]):
        with pytest.raises(SystemExit):
            cli.main(given)


def test_logging(monkeypatch):
    from tableguard import log

    monkeypatch.setenv(log.LEVEL_VARIABLE, "debug")
    root = log.configure()
    n = len(root.handlers)
    assert log.configure() is root and len(root.handlers) == n and root.level == 10
    assert log.get_logger("tableguard.cli").name == log.get_logger("cli").name == "tableguard.cli"
    monkeypatch.delenv(log.LEVEL_VARIABLE)
    assert log.configure().level == 20
