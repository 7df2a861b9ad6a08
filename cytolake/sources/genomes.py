"""Chromosome lengths of public assemblies."""

from pyspark.sql import DataFrame, SparkSession

#: Lengths of the numbered chromosomes in order, then X and Y.
LENGTHS = {
    "hg19": [249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895, 115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560, 59373566],
    "hg38": [248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309, 114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415],
    "mm10": [195471971, 182113224, 160039680, 156508116, 151834684, 149736546, 145441459, 129401213, 124595110, 130694993, 122082543, 120129022, 120421639, 124902244, 104043685, 98207768, 94987271, 90702639, 61431566, 171031299, 91744698],
    "mm39": [195154279, 181755017, 159745316, 156860686, 151758149, 149588044, 144995196, 130127694, 124359700, 130530862, 121973369, 120092757, 120883175, 125139656, 104073951, 98008968, 95294699, 90720763, 61420004, 169476592, 91455967],
}


def chromosome_sizes(spark: SparkSession, genome: str) -> DataFrame:
    """chr, size."""
    if genome not in LENGTHS:
        raise ValueError(f"genome must be one of {sorted(LENGTHS)}, or give sizes")
    sizes = LENGTHS[genome]
    names = [f"chr{i + 1}" for i in range(len(sizes) - 2)] + ["chrX", "chrY"]
    return spark.createDataFrame(list(zip(names, sizes, strict=True)), "chr string, size bigint")
