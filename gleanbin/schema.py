"""Schemas of the corpus store, and checks of its closed domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as parse

ADDRESS = "decimal(20,0)"  # an unsigned 64-bit number fits no long

BINARIES = "id int, path string, name string, optimisation string, linkage string, compiler string, arch string, sha256 binary, stripped boolean, size long, language string, dynamic_imports array<string>, version string, bin_format string, bin_type string"
VEX = f"struct<jumpkinds:array<string>,constants:array<bigint>,ninstructions:int,ntemp_vars:int,operations:array<string>,callees:array<{ADDRESS}>,sum_jumpkinds:map<string,int>,sum_operations:map<string,int>>"
TAINTS = "struct<ntainted:int,register_classes:array<int>,tainted:array<string>,nflows:int,flows:array<string>,t_stack_args:int,t_stack_vars:int,t_heap_vars:int,t_code_locs:int>"
FUNCTIONS = (
    "id int, binary_id int, name string, real_name string, signature string, returns string, size int, num_args int, local_stack_bytes long, "
    f"vaddr {ADDRESS}, binding string, arguments array<string>, heap_arguments array<string>, tls_arguments array<string>, callers array<string>, "
    "callees array<string>, closure array<string>, data_refs array<string>, imported_data_refs array<string>, tainted_flows array<struct<func:string,args:array<string>>>, "
    "tainted_args map<string,map<string,array<string>>>, tainted_args_closure map<string,map<string,array<string>>>, "
    f"vex {VEX}, sse struct<heap_vars:array<bigint>,stack_vars:array<bigint>,stack_args:array<bigint>,taints:{TAINTS}>, cfg string, sha256 binary, "
    "opcode_hash binary, asm_hash binary, opcode_minhash array<bigint>, icfg_embedding array<double>, callgraph_node_embedding array<double>, noreturn boolean"
)
LIBRARIES = "id int, path string, name string"
PROTOTYPES = "id int, library int, name string, real_name string, local_stack_bytes long, arguments array<string>, num_args int, heap_arguments array<string>, `return` string, tls_arguments array<string>"
EMBEDDINGS = "function_id int, embedding array<double>"
EDGES = "binary_id int, src string, dst string, kind string"
STATEMENTS = "binary_id int, function_id int, bb_idx int, stmt_idx int, kind string, outputs array<string>, inputs array<string>"

#: The closed domains of the store's columns.
DOMAINS = {
    "arch": ["x86", "x86_64", "armv6", "armv7", "ppc64"],
    "binding": ["GLOBAL", "WEAK", "LOCAL", "UNKNOWN"],
    "bin_format": ["elf", "pe", "macho"],
    "bin_type": ["object", "executable", "shared_library"],
    "linkage": ["dynamic", "static"],
}


def struct(ddl: str):
    return parse(ddl)


def valid(df: DataFrame) -> Column:
    """Whether each closed-domain column of a row is null or in its domain."""
    ok = F.lit(True)
    for name, values in DOMAINS.items():
        if name in df.columns:
            ok = ok & (F.col(name).isNull() | F.col(name).isin(values))
    return ok


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows within the domains, and the others."""
    ok = valid(df)
    return df.where(ok), df.where(~ok)
