"""The three models of the extraction dataflow from ONNX files, for Models: sessions are made in the workers, once in each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import SparkFiles

from ..sources.images import decode_image
from ..sources.readers import PROVIDERS
from .extract import Models


def open_session(path: str, threads: int = 1):
    """An inference session with the preferred providers that are there. A path without a folder is a file that was added to the job.

    A worker holds one core, so a session takes one thread unless told otherwise.
    """
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.log_severity_level = 3
    options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
    options.execution_mode = onnxruntime.ExecutionMode.ORT_SEQUENTIAL
    options.intra_op_num_threads, options.inter_op_num_threads = threads, 1
    there = onnxruntime.get_available_providers()
    return onnxruntime.InferenceSession(path if "/" in path else SparkFiles.get(path), sess_options=options, providers=[p for p in PROVIDERS if p in there])


def layout_model(path: str) -> Callable[[], Callable]:
    """Rows and, where the model has a second output, how many of them count."""

    def build():
        session = open_session(path)
        wanted = {i.name for i in session.get_inputs()}

        def run(inputs: dict[str, np.ndarray]):
            out = session.run(None, {k: v for k, v in inputs.items() if k in wanted})
            return out[0], int(np.asarray(out[1]).ravel()[0]) if len(out) > 1 else len(out[0])

        return run

    return build


def detection_model(path: str) -> Callable[[], Callable]:
    def build():
        session = open_session(path)
        name = session.get_inputs()[0].name
        return lambda tensor: session.run(None, {name: tensor})[0][0, 0]

    return build


def recognition_model(path: str) -> Callable[[], Callable]:
    """A batch of tensors of one width in one run."""

    def build():
        session = open_session(path)
        name = session.get_inputs()[0].name
        return lambda tensors: session.run(None, {name: tensors})[0]

    return build


def onnx_models(layout: str, detection: str, recognition: str, charset: list[str]) -> Models:
    """Models from three files: paths that every worker can open, or names of files added with SparkContext.addFile."""
    return Models(lambda: decode_image, layout_model(layout), detection_model(detection), recognition_model(recognition), tuple(charset))
