"""Model steps: column functions that load their model once per Python worker.

What :func:`quire.plans.ingest.ingest_into`, :func:`quire.plans.retrieve.retrieve`,
:func:`quire.plans.answer.answer_questions` and :func:`quire.plans.chat.chat_batch` take as ``embed``, ``emotion``, ``scorer`` and
``generate`` may be made here. A worker runs many tasks; a model kept by the task would be loaded for each.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from typing import Tuple  # noqa: UP035 - the form of the hint that Spark reads

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def loaded(name: str, load: Callable[[], object]) -> object:
    """The model of this name in this process. It is kept beside the interpreter's own tables, as functions
    and their modules are unpickled anew for every task."""
    models = vars(sys).setdefault("_models_of_worker", {})
    if name not in models:
        models[name] = load()
    return models[name]


def model_function(load: Callable[[], object], run: Callable[..., pd.Series], returns: str, inputs: int = 1) -> Callable[..., Column]:
    """A function of ``inputs`` columns that gives ``run(model, *batch)`` of Arrow batches as type ``returns``.

    ``load`` makes the model, in a worker and once there; nothing of it passes through the driver.
    """
    name = uuid.uuid4().hex
    if inputs == 1:
        @pandas_udf(returns)
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = loaded(name, load)
            for batch in batches:
                yield run(model, batch)
        return call

    @pandas_udf(returns)
    def call_all(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for batch in batches:
            yield run(model, *batch)
    return call_all
