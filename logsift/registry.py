"""Named extension points."""

from __future__ import annotations


from collections.abc import Iterator
from contextlib import contextmanager


class Registry(dict):
    """A name-to-object table whose ``register`` works as a decorator or as a plain call."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def register(self, name: str, value=None):
        if value is not None:
            self[name] = value
            return value
        return lambda function: self.register(name, function)

    def unregister(self, name: str) -> None:
        self[name]
        del self[name]

    @contextmanager
    def registered(self, name: str, value) -> Iterator[None]:
        """``name`` stands for ``value`` inside the block, and for what it was before afterwards."""
        before = self.get(name)
        self.register(name, value)
        try:
            yield
        finally:
            self.unregister(name)
            if before is not None:
                self.register(name, before)

    def __missing__(self, name):
        raise KeyError(f"no {self.kind} named {name!r}; known: {', '.join(sorted(self))}")


preprocessors = Registry("preprocessor")
features = Registry("feature")
binary_models = Registry("binary model")
multi_models = Registry("multi-class model")
prediction_reports = Registry("prediction report")
model_reports = Registry("model report")
saved_models = Registry("saved model")  # the class that loads what a named model saved
