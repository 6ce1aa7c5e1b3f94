"""The registered queries of this subpackage, and SQL where it can express them."""

from .ann_search import SQL as ANN_SQL
from .ann_search import op9_ann_search
from .chat_format import SQL as CHAT_SQL
from .chat_format import op1_chat_format
from .decontaminate import SQL as DECONTAMINATION_SQL
from .decontaminate import op11_decontaminate
from .embedding_dedup import SQL as EMBEDDING_SQL
from .embedding_dedup import op5_embedding_dedup
from .fill_middle import SQL as MIDDLE_SQL
from .fill_middle import op12_fill_in_middle
from .language_id import op2_language_id
from .license_scan import op4_license_scan
from .mixing import op8_mix_sources
from .packing import op7_best_fit_packing
from .repair import SQL as REPAIR_SQL
from .repair import op13_conversation_repair
from .simhash import op10_simhash
from .toxicity import op3_toxicity
from .url_filter import SQL as URL_SQL
from .url_filter import op6_url_filter

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_mix_sources": op8_mix_sources,
    "op9_ann_search": op9_ann_search,
    "op10_simhash": op10_simhash,
    "op11_decontaminate": op11_decontaminate,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL = {
    "op1_chat_format": CHAT_SQL,
    "op5_embedding_dedup": EMBEDDING_SQL,
    "op6_url_filter": URL_SQL,
    "op9_ann_search": ANN_SQL,
    "op11_decontaminate": DECONTAMINATION_SQL,
    "op12_fill_in_middle": MIDDLE_SQL,
    "op13_conversation_repair": REPAIR_SQL,
}
