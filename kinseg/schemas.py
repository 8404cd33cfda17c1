"""Spark schemas of the tables that stages exchange. Coordinates are 1-based and closed unless named start0/end0."""

READS = "sample string, bam_ord int, ord long, qname string, flag int, chrom string, ref_idx int, start int, end int, mapq int, cigar string, mate_ref_idx int, mate_start int, tlen int, seq string, qual string, tags map<string,string>"
READ_DEPTH = "chrom string, start int, end int, rd0 int, rd1 int, rd2 int, gc int, mappability double"
PAIRS = "sample string, chrom string, left_first long, right_first long, left_second long, right_second long"
INTERVALS = "chrom string, start long, end long"
SIGNAL = "chrom string, start0 int, end0 int, value double"
PARAMETERS = "sample string, median double, mad double"
PED = "family_id string, individual_id string, paternal_id string, maternal_id string, sex int, phenotype int"
CALLS = "chrom string, start long, end long, type0 string, type1 string, type2 string, score double, evidence string"
FINAL = "chrom string, start long, end long, type0 string, type1 string, type2 string, evidence string"
REFERENCE = "chrom string, chunk_start int, bases string"
