"""Declared schemas of the three logical tables: reading CSV with them needs no
inference pass, and a column that does not fit fails early."""

from __future__ import annotations

#: T1, the topic rows.
TOPIC_FACTS = (
    "device string, country string, topic string, level1 string, level2 string, "
    "raw_messages bigint, raw_users bigint, raw_conversations bigint, date date"
)
#: T1 under the names of the export jobs.
EXPORTED_FACTS = TOPIC_FACTS.replace("level1", "category").replace("level2", "sub_category")
#: T2, the category map.
MAP_SCHEMA = "topic string, category string, sub_category string"
#: T3, the keyword rows.
KEYWORD_SCHEMA = "keyword string, volume bigint, brands string, level1 string, level2 string, country string, date date"
