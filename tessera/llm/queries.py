"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, collocations, licenses, linededup, neardup, neighbours, packing, periodic, pii, secrets, tokenfiles, toxicity, transport

QUERIES = {
    f.__name__: f
    for f in (
        secrets.op1_secret_scan,
        transport.op2_transport_stream,
        pii.op3_personal_data,
        packing.op4_best_fit_packing,
        bpe.op5_byte_bpe,
        neighbours.op6_nearest,
        toxicity.op7_toxicity,
        linededup.op8_line_dedup,
        licenses.op9_licence_scan,
        neardup.op10_near_duplicates,
        collocations.op11_collocations,
        periodic.op12_periodic_runs,
        tokenfiles.op13_token_files,
    )
}
ORACLES = {"op1_secret_scan": secrets.OP1_SQL, "op6_nearest": neighbours.OP6_SQL, "op8_line_dedup": linededup.OP8_SQL, "op10_near_duplicates": neardup.OP10_SQL, "op11_collocations": collocations.OP11_SQL}
