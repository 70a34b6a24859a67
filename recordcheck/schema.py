"""Spark types of the records that the operators exchange."""

from __future__ import annotations

AUTHOR = "struct<family:string,given:string,literal:string>"
AUTHORS = f"array<{AUTHOR}>"
PROVENANCE = "struct<source:string,record_url:string,native_id:string,retrieved_at:timestamp>"

#: A work as any source describes it; absent values are null, never ''.
WORK = (
    f"struct<title:string,authors:{AUTHORS},year:int,venue:string,venue_short:string,publisher:string,volume:string,issue:string,pages:string,"
    f"doi:string,url:string,isbn:array<string>,issn:array<string>,arxiv_id:string,type:string,is_preprint:boolean,related_dois:array<string>,sources:array<{PROVENANCE}>>"
)
WORK_FIELDS = ("title", "authors", "year", "venue", "venue_short", "publisher", "volume", "issue", "pages", "doi", "url", "isbn", "issn", "arxiv_id", "type", "is_preprint", "related_dois", "sources")
#: Merged by taking the first present value in order of source precedence.
MERGED_FIELDS = ("title", "year", "venue", "venue_short", "publisher", "volume", "issue", "pages", "doi", "url", "isbn", "issn", "arxiv_id", "type")

PART = "struct<kind:string,text:string>"
FIELD = f"struct<name:string,name_start:int,name_end:int,value_start:int,value_end:int,raw:string,parts:array<{PART}>,text:string,unresolved:array<string>>"
ITEM_COLUMNS = f"pos int, kind string, type string, key string, start int, end int, type_start int, type_end int, key_start int, key_end int, close_pos int, open_delim string, text string, fields array<{FIELD}>, name string, parts array<{PART}>, message string, line int"
CHECK = "struct<id:string,label:string,state:string,detail:string>"
EVIDENCE = "struct<source:string,value:string,agrees:boolean>"
PATCH_COLUMNS = "kind string, value string, term string, to string"

# The enumerations of the data model.
WORK_TYPES = ("article", "inproceedings", "proceedings", "book", "inbook", "incollection", "phdthesis", "mastersthesis", "techreport", "misc", "online", "software", "dataset", "preprint")
STATES = ("VERIFIED", "HIGH CONFIDENCE", "AMBIGUOUS", "UNVERIFIED", "CONFLICT", "UNREACHABLE", "NOT CHECKED", "MISSING")
CONFIDENCES = ("VERY HIGH", "HIGH", "POSSIBLE", "LOW")
LOOKUP_STATUSES = ("OK", "NO RECORD FOUND", "LOOKUP FAILED", "RATE LIMITED", "NETWORK UNAVAILABLE")
CATEGORIES = ("conflict", "missing", "format", "version", "key", "url")
