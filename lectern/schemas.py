"""Schemas of the entities that operators exchange, as DDL. Order is data: each table that has one carries an ordinal."""

from __future__ import annotations

TOC_ENTRY = "book_id string, toc_idx int, level int, title string, start_page int"
IMAGE = "path string, type string, caption string"
EQUATION = "path string, type string, label string"
SECTION = (
    "section_id string, title string, level int, chapter string, parent_id string, children array<string>, start_page int, end_page int, text string, "
    "images array<struct<path:string,type:string,caption:string>>, equations array<struct<path:string,type:string,label:string>>"
)
NODE = (
    "book_id string, node_id string, parent_id string, ord int, title string, page_range string, keywords array<string>, tfidf_keywords array<string>, abstract string, has_visuals boolean"
)
CANDIDATE = (
    "section_id string, title string, chapter_title string, parent_title string, page_range string, keywords array<string>, tfidf_keywords array<string>, abstract string, has_visuals boolean, is_deprioritized boolean"
)
CONFUSABLE_PAIR = "section_a string, section_b string, overlap double, shared_keywords array<string>"
PAGE = "book_id string, page int, text string"
SPAN = "book_id string, page int, block int, line int, span int, text string, size double, flags int, font string, x0 double, y0 double, x1 double, y1 double"
RECT = "book_id string, page int, idx int, x0 double, y0 double, x1 double, y1 double"
BLOCK = "book_id string, seq int, block_type string, id string, html string, heading_level int, n_images int"
SCAN_RESULT = "book_id string, classification string, needs_force_ocr boolean, avg_chars_per_page double, total_pages long, pages_sampled long"
PICK = "section_id string, confidence string, reason string"
QUESTION = "question string, expected_sections array<string>, difficulty string, type string, notes string"
QA_OUTLIER = "section_id string, n_chars long, ratio double, kind string"
CHUNK = "book_id string, chunk int, first_page int, last_page int, status string"
BOOK = "book_id string, display_name string, created_at timestamp"
THREAD = "thread_id string, book_id string, title string, created_at timestamp, updated_at timestamp"
MESSAGE = "message_id string, thread_id string, role string, content string, routed_sections string, images_used string, created_at timestamp"
