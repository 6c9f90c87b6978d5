"""Explicit types of reports and records; nothing is inferred."""

from __future__ import annotations

SECTION = "array<struct<name:string,virtual_address:long,virtual_size:long,raw_size:long,raw_offset:long,characteristics:long,entropy:double>>"
IMPORTS = "array<struct<dll:string,functions:array<string>>>"
REPORT = (
    f"struct<sha256:string,size:long,machine:long,timestamp:long,entry_point:long,image_base:decimal(20,0),subsystem:long,is_dll:boolean,sections:{SECTION},imports:{IMPORTS},"
    f"overall_entropy:double,anomalies:array<string>,pe32plus:boolean,coff_characteristics:long,dll_characteristics:long,"
    "header:struct<major_linker_version:long,minor_linker_version:long,major_operating_system_version:long,minor_operating_system_version:long,major_image_version:long,minor_image_version:long,"
    "major_subsystem_version:long,minor_subsystem_version:long,sizeof_code:long,sizeof_headers:long,sizeof_heap_commit:decimal(20,0),checksum:long>,"
    f"data_directories:array<struct<virtual_address:long,size:long>>,exports:array<string>,delay_imports:{IMPORTS},resource_types:array<string>,entry_section:string,size_of_image:long,"
    "overlay_size:long,n_symbols:long,certificate:binary,histogram:array<long>,byteentropy:array<long>>"
)
STRINGS = "struct<numstrings:long,avlength:double,printabledist:array<long>,printables:long,entropy:double,paths:long,urls:long,registry:long,MZ:long>"
OPTIONAL = (
    "struct<subsystem:string,dll_characteristics:array<string>,magic:string,major_image_version:long,minor_image_version:long,major_linker_version:long,minor_linker_version:long,"
    "major_operating_system_version:long,minor_operating_system_version:long,major_subsystem_version:long,minor_subsystem_version:long,sizeof_code:long,sizeof_headers:long,sizeof_heap_commit:decimal(20,0)>"
)
COFF = "struct<timestamp:long,machine:string,characteristics:array<string>>"
GENERAL = "struct<size:long,vsize:long,has_debug:long,exports:long,imports:long,has_relocations:long,has_resources:long,has_signature:long,has_tls:long,symbols:long>"
RECORD_SECTION = "struct<entry:string,sections:array<struct<name:string,size:long,entropy:double,vsize:long,props:array<string>>>>"
DATA_DIRECTORIES = "array<struct<name:string,size:long,virtual_address:long>>"
#: Raw JSON writes imports as an object from library to functions; readers turn it into the ordered array.
RAW_V2 = (
    f"sha256 string, md5 string, label int, avclass string, appeared string, histogram array<long>, byteentropy array<long>, strings {STRINGS}, general {GENERAL}, "
    f"header struct<coff:{COFF},optional:{OPTIONAL}>, section {RECORD_SECTION}, imports {IMPORTS}, exports array<string>, datadirectories {DATA_DIRECTORIES}"
)
