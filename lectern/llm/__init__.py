"""Operations of a training-data pipeline; nothing outside this subpackage imports it.

``lectern.llm.registry`` holds the queries and the SQL that check them.
"""
