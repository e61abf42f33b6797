"""Schema models and their loaders."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, Field, ValidationError, field_validator, model_validator

from . import dtypes

OnFailure = Literal["raise", "null"]
Profile = Literal["strict", "clean", "audit"]
INVALID = "Invalid schema configuration"


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class _Reference(_Strict):
    """A registered function by name, with its arguments."""

    name: str
    args: dict[str, Any] = Field(default_factory=dict)


class Parser(_Reference):
    """A column parser."""


class Check(_Reference):
    """A column check."""


class FrameParser(_Reference):
    """A frame parser."""


class FrameCheck(_Reference):
    """A frame check."""


class ColumnSchema(_Strict):
    """Rules of one column."""

    dtype: str
    synonyms: list[str] = Field(default_factory=list)
    parsers: list[Parser] = Field(default_factory=list)
    checks: list[Check] = Field(default_factory=list)
    required: bool = True
    nullable: bool = False
    on_failure: OnFailure | None = None

    @field_validator("dtype")
    @classmethod
    def _known(cls, value: str) -> str:
        dtypes.resolve(value)
        return value

    @model_validator(mode="after")
    def _can_be_null(self):
        if self.on_failure == "null" and not self.nullable:
            raise ValueError("on_failure='null' needs nullable=True")
        return self


class SchemaModel(_Strict):
    """Rules of a frame. Columns it does not name pass through untouched."""

    lazy: bool = True
    coerce: bool = True
    profile: Profile = "strict"
    columns: dict[str, ColumnSchema]
    frame_parsers: list[FrameParser] = Field(default_factory=list)
    frame_checks: list[FrameCheck] = Field(default_factory=list)

    def __repr__(self) -> str:
        return f"<SchemaModel lazy={self.lazy}, coerce={self.coerce}, columns=[{', '.join(self.columns)}]>"

    def resolve_on_failure(self, name: str) -> OnFailure:
        """A column's own setting; else null in a clean profile where it may be null."""
        column = self.columns[name]
        if column.on_failure is not None:
            return column.on_failure
        return "null" if self.profile == "clean" and column.nullable else "raise"

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> SchemaModel:
        try:
            return cls.model_validate(data)
        except ValidationError as e:
            raise ValueError(f"{INVALID}: {e}") from e

    @classmethod
    def from_python(cls, data: SchemaModel | Mapping[str, Any]) -> SchemaModel:
        return data if isinstance(data, cls) else cls.from_dict(data)

    @classmethod
    def from_json(cls, text: str) -> SchemaModel:
        return cls.from_dict(_read(lambda: _mapping(json.loads(text))))

    @classmethod
    def from_yaml(cls, text: str) -> SchemaModel:
        yaml = _yaml()
        return cls.from_dict(_read(lambda: _mapping(yaml.safe_load(text)), yaml.YAMLError))

    @classmethod
    def from_json_file(cls, path: str | Path) -> SchemaModel:
        return cls.from_json(_read(lambda: Path(path).read_text(encoding="utf-8")))

    @classmethod
    def from_yaml_file(cls, path: str | Path) -> SchemaModel:
        return cls.from_yaml(_read(lambda: Path(path).read_text(encoding="utf-8")))

    @classmethod
    def from_file(cls, path: str | Path) -> SchemaModel:
        """By suffix, in either case: .json, .yaml or .yml."""
        suffix = Path(path).suffix.lower()
        if suffix == ".json":
            return cls.from_json_file(path)
        if suffix in (".yaml", ".yml"):
            return cls.from_yaml_file(path)
        raise ValueError(f"{INVALID}: unsupported suffix {suffix!r}")


class SchemaLoader:
    """Loads schemas with a model class of choice; errors of files and parsers come as they are."""

    def __init__(self, model_cls: type[SchemaModel] = SchemaModel):
        self.model_cls = model_cls

    def from_mapping(self, data: Mapping[str, Any]) -> SchemaModel:
        return self.model_cls.from_dict(data)

    def from_python(self, data: SchemaModel | Mapping[str, Any]) -> SchemaModel:
        return self.model_cls.from_python(data)

    def from_json_str(self, text: str) -> SchemaModel:
        return self.from_mapping(json.loads(text))

    def from_json_file(self, path: str | Path) -> SchemaModel:
        return self.from_json_str(Path(path).read_text(encoding="utf-8"))

    def from_yaml_str(self, text: str) -> SchemaModel:
        return self.from_mapping(_yaml().safe_load(text))

    def from_yaml_file(self, path: str | Path) -> SchemaModel:
        return self.from_yaml_str(Path(path).read_text(encoding="utf-8"))


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ImportError("PyYAML is needed to read YAML schemas") from e
    return yaml


def _mapping(data: Any) -> Mapping[str, Any]:
    if not isinstance(data, Mapping):
        raise ValueError("a schema is a mapping")
    return data


def _read(get, *more: type[Exception]):
    try:
        return get()
    except (OSError, ValueError, *more) as e:
        raise ValueError(f"{INVALID}: {e}") from e
