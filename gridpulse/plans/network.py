"""A trained network as a table of weights, and its forward pass over whole batches of rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Where a weight comes from if it is added without an input.
BIAS = -1
WEIGHTS = "layer int, unit int, source int, weight double"


@dataclass(frozen=True)
class Network:
    """Fully connected layers; every one but the last goes through a logistic function.

    ``layers`` holds for each layer its matrix (units by inputs) and the bias of its units.
    """

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    @staticmethod
    def of_vector(sizes: list[int], weights: np.ndarray) -> Network:
        """From one vector: layer by layer the weights of each input for all units, then the biases."""
        wanted = sum((n_in + 1) * n_out for n_in, n_out in zip(sizes, sizes[1:]))
        if wanted != len(weights):
            raise ValueError(f"{len(weights)} weights, but the layers {sizes} take {wanted}")
        layers, at = [], 0
        for n_in, n_out in zip(sizes, sizes[1:]):
            matrix = weights[at : at + n_in * n_out].reshape(n_in, n_out).T
            at += n_in * n_out
            layers.append((matrix, weights[at : at + n_out]))
            at += n_out
        return Network(tuple(layers))

    @staticmethod
    def of_model(model) -> Network:
        """From a fitted multilayer perceptron."""
        return Network.of_vector(list(model.getLayers()), np.array(model.weights.toArray()))

    @staticmethod
    def of_table(weights: DataFrame) -> Network:
        """From a table made by :meth:`table`; its size is that of the network, not of the data."""
        rows = weights.toPandas()
        layers = []
        for _, part in rows.groupby("layer", sort=True):
            n_out, n_in = int(part["unit"].max()) + 1, int(part["source"].max()) + 1
            matrix, bias = np.zeros((n_out, n_in)), np.zeros(n_out)
            added = part["source"] == BIAS
            bias[part.loc[added, "unit"]] = part.loc[added, "weight"]
            matrix[part.loc[~added, "unit"], part.loc[~added, "source"]] = part.loc[~added, "weight"]
            layers.append((matrix, bias))
        return Network(tuple(layers))

    def table(self, spark: SparkSession) -> DataFrame:
        """(layer, unit, source, weight), the bias of a unit under source -1."""
        rows = []
        for k, (matrix, bias) in enumerate(self.layers):
            for unit in range(len(bias)):
                rows.append((k, unit, BIAS, float(bias[unit])))
                rows.extend((k, unit, source, float(w)) for source, w in enumerate(matrix[unit]))
        return spark.createDataFrame(rows, WEIGHTS)

    def raw(self, inputs: np.ndarray) -> np.ndarray:
        """Activation of the output units, one row per input row."""
        values = inputs
        for k, (matrix, bias) in enumerate(self.layers):
            values = values @ matrix.T + bias
            if k + 1 < len(self.layers):
                values = 1.0 / (1.0 + np.exp(-values))
        return values

    def score(self, rows: DataFrame, features: list[str]) -> DataFrame:
        """The rows with ``prediction``, the number of the greatest output unit; null if a feature is.

        The weights travel with the function, a few kilobytes; the rows are not shuffled.
        """
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(names.index(f)).cast(pa.float64()) for f in features]
                inputs = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
                known = np.ones(len(batch), bool)
                for c in columns:
                    known &= c.is_valid().to_numpy(zero_copy_only=False)
                best = self.raw(np.nan_to_num(inputs)).argmax(axis=1).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(best, mask=~known)], names=[*names, "prediction"]
                )

        return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("prediction", T.DoubleType())]))
