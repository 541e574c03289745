"""Schemas of particle tables, volumes and poses."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of the native table by position, and those printed as whole numbers.
TBL_COLUMNS = (
    "tag aligned averaged dx dy dz tdrot tilt narot cc cc2 cpu ftype ymintilt ymaxtilt xmintilt xmaxtilt fs1 fs2 tomo reg "
    "class annotation x y z dshift daxis dnarot dcc otag npar col33 ref sref"
).split()
WHOLE_POSITIONS = (1, 2, 3, 13, 20, 21, 22, 23, 31, 32, 34, 35)

# The STAR columns that crop and alignment write, in their order, as far as a table has them.
STAR_OUTPUT = (
    "rlnImageName rlnMicrographName rlnTomoName rlnTomoParticleId rlnCoordinateX rlnCoordinateY rlnCoordinateZ "
    "rlnCenteredCoordinateXAngst rlnCenteredCoordinateYAngst rlnCenteredCoordinateZAngst rlnAngleRot rlnAngleTilt rlnAnglePsi "
    "rlnOriginXAngst rlnOriginYAngst rlnOriginZAngst"
).split()

TBL = T.StructType([T.StructField(c, T.DoubleType()) for c in TBL_COLUMNS])
VLL = T.StructType([T.StructField("tomo_id", T.LongType()), T.StructField("rlnMicrographName", T.StringType()), T.StructField("tomo_path", T.StringType())])
VOLUME = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("nz", T.IntegerType()),
        T.StructField("ny", T.IntegerType()),
        T.StructField("nx", T.IntegerType()),
        T.StructField("voxel_size", T.DoubleType()),
        T.StructField("data", T.BinaryType()),
    ]
)
POSE = ("tdrot", "tilt", "narot", "dx", "dy", "dz", "cc")
