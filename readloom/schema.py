"""Record shapes and the fixed numbers of the alignment formats."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: FLAG bits of the SAM specification
PAIRED, PROPER, UNMAP, MUNMAP, REVERSE, MREVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
READ1, READ2, SECONDARY, QCFAIL, DUP = 0x40, 0x80, 0x100, 0x200, 0x400
#: reads a pileup leaves out
PILEUP_MASK = UNMAP | SECONDARY | QCFAIL | DUP
#: letters of the bits in their order, lowest first
FLAG_LETTERS = "pPuUrR12sfd"
CIGAR_OPS = "MIDNSHP=X"

ALIGNMENT = T.StructType([
    T.StructField("qname", T.StringType()),
    T.StructField("flag", T.IntegerType()),
    T.StructField("rname", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("mapq", T.IntegerType()),
    T.StructField("cigar", T.StringType()),
    T.StructField("rnext", T.StringType()),
    T.StructField("pnext", T.IntegerType()),
    T.StructField("tlen", T.IntegerType()),
    T.StructField("seq", T.StringType()),
    T.StructField("qual", T.StringType()),
    T.StructField("aux", T.MapType(T.StringType(), T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))),
])
