"""Registry of user functions and the functions that come with the package."""

from .builtins import default_registry
from .registry import ColumnFunctionWrapper, ColumnPurityError, DecoratorAdapter, FrameFunctionWrapper, FrameShapeError, FunctionRegistry, RegistryError, SignatureValidator

__all__ = ["ColumnFunctionWrapper", "ColumnPurityError", "DecoratorAdapter", "FrameFunctionWrapper", "FrameShapeError", "FunctionRegistry", "RegistryError", "SignatureValidator", "default_registry"]
