"""Vector expressions and the byte histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

DIM = 256


def _double(c) -> Column:
    return col(c).cast("array<double>")


def dot(a, b) -> Column:
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """``v`` divided by its length, in double precision; a zero vector is unchanged.

    The length is bound as the argument of an outer one-element transform, so
    it is computed once per vector and not once per element.
    """
    scaled = F.transform(
        F.array(norm(v)),
        lambda n: F.when(n > 0, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v)),
    )
    return scaled[0]


def cosine(v, query, query_norm=None) -> Column:
    """dot/(|v||q|), 0 when that denominator is 0; pass the norm of a known query."""
    qn = norm(query) if query_norm is None else F.lit(query_norm)
    denominator = norm(v) * qn
    return F.when(denominator > 0, dot(v, query) / denominator).otherwise(F.lit(0.0))


def text_vector(text: str) -> list[float]:
    """Unit byte histogram of a query string (one value, made on the driver)."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8"), dtype=np.uint8), minlength=DIM)
    length = float(np.sqrt((counts.astype(np.float64) ** 2).sum()))
    return [float(c) / length if length else 0.0 for c in counts]


def literal_vector(values) -> Column:
    """A query vector as one literal array: constant-folded, so no join is needed."""
    return F.lit([float(x) for x in values])


def _byte_counts_udf(unit: bool):
    # Nested so that the function travels to the executors by value.
    @F.arrow_udf("array<float>" if unit else "array<int>")
    def byte_counts(texts):
        import numpy
        import pyarrow

        binary = texts.cast(pyarrow.large_binary())
        offsets = numpy.frombuffer(binary.buffers()[1], dtype=numpy.int64)
        offsets = offsets[binary.offset : binary.offset + len(binary) + 1]
        data = binary.buffers()[2]
        data = numpy.frombuffer(data, dtype=numpy.uint8) if data else numpy.empty(0, numpy.uint8)
        counts = numpy.zeros((len(binary), 256), dtype=numpy.int32)
        # Slices of 128 KB, of several rows or of one, so that short texts share a call and long ones need little room.
        lo, most = 0, 1 << 17
        while lo < len(binary):
            hi = max(lo + 1, int(numpy.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
            if hi == lo + 1:
                for at in range(offsets[lo], offsets[hi], most):
                    counts[lo] += numpy.bincount(data[at : min(at + most, offsets[hi])], minlength=256)
            else:
                rows = numpy.repeat(numpy.arange(hi - lo, dtype=numpy.int32) * 256, numpy.diff(offsets[lo : hi + 1]))
                rows += data[offsets[lo] : offsets[hi]]
                counts[lo:hi] = numpy.bincount(rows, minlength=256 * (hi - lo)).reshape(-1, 256)
            lo = hi
        if unit:
            exact = counts.astype(numpy.float64)
            length = numpy.sqrt((exact * exact).sum(axis=1, keepdims=True))
            counts = (exact / numpy.where(length > 0, length, 1)).astype(numpy.float32)
        sizes = numpy.arange(0, 256 * (len(binary) + 1), 256, dtype=numpy.int32)
        mask = pyarrow.array(texts.is_null().to_numpy(zero_copy_only=False))
        return pyarrow.ListArray.from_arrays(
            pyarrow.array(sizes), pyarrow.array(counts.ravel()), mask=mask
        )

    return byte_counts


def byte_counts(c) -> Column:
    """Counts of the 256 byte values of a STRING or BINARY column, one array per row.

    The one Arrow UDF of the library: a row's bytes are counted in place, while
    a native explode would make one row per byte and shuffle them by row id.
    Bind it to a column before vector expressions: Spark takes no UDF in a lambda.
    """
    return _byte_counts_udf(False)(col(c))


def unit_byte_counts(c) -> Column:
    """``byte_counts`` scaled to length 1, as stored for a text; zeros for an empty one."""
    return _byte_counts_udf(True)(col(c))
