"""Columns of reads and of what is stored beside them."""

from __future__ import annotations

TAGS = "array<struct<pos:int,tag:string,type:string,value:string>>"
#: A read as it stands in a file; pos and ploc are 1-based.
READS = (
    "file_id int, row_id long, rname string, flag int, chr string, pos long, mapq int, cigar string, "
    f"pchr string, ploc long, tlen int, seq string, qual string, tags {TAGS}"
)
#: A header line.
HEADERS = "file_id int, line_no long, record_type string, attrs map<string,string>, raw string"
#: Columns of a line of text, in order.
LINE = ("rname", "flag", "chr", "pos", "mapq", "cigar", "pchr", "ploc", "tlen", "seq", "qual")
