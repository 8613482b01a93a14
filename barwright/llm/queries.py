"""The queries of this folder's operators, by name, and the SQL for those that SQL can express."""

from barwright.llm import decontamination, embedding_dedup, exact_dedup, fill_in_middle, filter_audit, minhash_dedup, warc
from barwright.llm.decontamination import op11_decontamination
from barwright.llm.embedding_dedup import op9_embedding_dedup
from barwright.llm.exact_dedup import op8_exact_dedup
from barwright.llm.fill_in_middle import op13_fill_in_middle
from barwright.llm.filter_audit import op12_filter_audit
from barwright.llm.license_scan import op2_license_scan
from barwright.llm.minhash_dedup import op5_minhash_dedup
from barwright.llm.mixing import op10_mixing
from barwright.llm.packing import op4_packing
from barwright.llm.sharding import op7_sharding
from barwright.llm.substring_dedup import op1_substring_dedup
from barwright.llm.toxicity import op3_toxicity
from barwright.llm.warc import op6_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_warc": op6_warc,
    "op7_sharding": op7_sharding,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_mixing": op10_mixing,
    "op11_decontamination": op11_decontamination,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {
    "op5_minhash_dedup": minhash_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_embedding_dedup": embedding_dedup.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
