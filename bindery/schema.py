"""Schemas of the library's tables."""

BOOK_FIELDS = (
    "id int, file_path string, title string, language string, isbn decimal(20,0), author string, contributor string, publisher string, subject array<string>, "
    "description string, pub_date date, rights string, series string, series_num float, date_added date"
)
LIBRARY_FIELDS = BOOK_FIELDS + ", is_local boolean, is_remote boolean"
META_FIELDS = "id int, version int, last_used_id int"
