"""Published result sweeps, used to replay reports and to check derived ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Published measurements (throughput tok/s, latency ms/tok, speed-up over
# the unassisted run, acceptance, GPU utilisation %).
DRAFT_COLUMNS = "thr double, sampling boolean, k int, tp double, lat double, speed double, acc double, util double"
DRAFT_1B = [
    (1e-4, False, 3, 19.995, 50.013, 1.301, 0.547, 89.08),
    (1e-4, False, 5, 18.653, 53.611, 1.214, 0.440, 86.79),
    (1e-4, False, 7, 16.696, 59.896, 1.086, 0.363, 72.30),
    (1e-4, True, 3, 19.833, 50.420, 1.290, 0.549, 89.88),
    (1e-4, True, 5, 18.226, 54.866, 1.186, 0.431, 76.08),
    (1e-4, True, 7, 16.510, 60.570, 1.074, 0.361, 73.84),
    (0.2, False, 3, 20.769, 48.150, 1.351, 0.609, 81.27),
    (0.2, False, 5, 20.535, 48.697, 1.336, 0.544, 76.91),
    (0.2, False, 7, 20.334, 49.178, 1.323, 0.500, 77.06),
    (0.2, True, 3, 20.425, 48.960, 1.329, 0.605, 79.97),
    (0.2, True, 5, 19.385, 51.585, 1.261, 0.490, 76.61),
    (0.2, True, 7, 19.152, 52.215, 1.246, 0.480, 75.21),
]
DRAFT_3B = [
    (0.2, False, 3, 17.099, 58.481, 1.112, 0.673, 88.14),
    (0.2, False, 5, 16.580, 60.313, 1.079, 0.610, 92.56),
    (0.2, False, 7, 15.928, 62.782, 1.036, 0.559, 92.61),
    (0.2, True, 3, 16.794, 59.546, 1.093, 0.660, 90.80),
    (0.2, True, 5, 16.324, 61.261, 1.062, 0.605, 91.41),
    (0.2, True, 7, 15.475, 64.621, 1.010, 0.556, 90.45),
]
CONFIG_COLUMNS = "cfg string, tp double, lat double, speed double, acc double, util double"
QUANTIZED_1B = [
    ("8-bit draft", 12.818, 78.018, 0.834, 0.602, 50.26),
    ("4-bit draft", 14.423, 69.335, 0.938, 0.539, 67.08),
    ("8-bit target", 14.661, 68.207, 0.954, 0.601, 46.25),
    ("8-bit tgt + 4-bit drft", 11.025, 90.702, 0.717, 0.537, 41.54),
]
QUANTIZED_3B = [
    ("8-bit draft", 9.358, 106.863, 0.609, 0.663, 42.91),
    ("4-bit draft", 10.627, 94.103, 0.691, 0.637, 74.52),
    ("8-bit target", 12.804, 78.101, 0.833, 0.661, 60.49),
    ("8-bit tgt + 4-bit drft", 8.607, 116.188, 0.560, 0.634, 55.15),
]
# The accuracy labels carry the non-breaking hyphen U+2011; see operators.report.plain_hyphens.
ACCURACY_COLUMNS = "q string, sampling string, acc double"
ACCURACY = [
    ("4‑bit", "greedy", 0.292),
    ("4‑bit", "sampled", 0.317),
    ("8‑bit", "greedy", 0.323),
    ("8‑bit", "sampled", 0.329),
    ("16‑bit", "greedy", 0.336),
    ("16‑bit", "sampled", 0.329),
]
QUANTIZED_COLUMNS = "q string, tp double, lat double, ppl double, util double"
QUANTIZED = [
    ("4-bit", 21.036, 47.538, 6.242, 70.37),
    ("8-bit", 9.028, 110.765, 5.640, 48.93),
    ("16-bit", 15.499, 64.519, 5.563, 97.97),
]
BASELINE_THROUGHPUT = 15.37051

TABLES = {
    "draft_1b": (DRAFT_1B, DRAFT_COLUMNS),
    "draft_3b": (DRAFT_3B, DRAFT_COLUMNS),
    "quantized_1b": (QUANTIZED_1B, CONFIG_COLUMNS),
    "quantized_3b": (QUANTIZED_3B, CONFIG_COLUMNS),
    "accuracy": (ACCURACY, ACCURACY_COLUMNS),
    "quantized": (QUANTIZED, QUANTIZED_COLUMNS),
}


def sweep_table(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = TABLES[name]
    return spark.createDataFrame(rows, schema)
