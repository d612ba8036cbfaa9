"""The mail record that parsers make and checks read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ADDRESS = "struct<display:string,addr:string,domain:string>"
LINK = "struct<href:string,text:string,domain:string,port:string,is_ip:boolean,is_shortener:boolean,punycode:boolean,mismatch:boolean>"
ATTACHMENT = "struct<name:string,mime:string,size:bigint,sha256:string,ext:string,macro_detected:boolean,is_archive:boolean,password_protected:boolean,nested_names:array<string>,has_active_content:boolean>"
HOP = "struct<raw:string,from_host:string,by_host:string,ip:string,ts:timestamp>"
IMAGE = "struct<mime:string,size:bigint,sha256:string,phash:bigint,colors:array<string>,width:int,height:int>"
PDF = "struct<javascript:boolean,open_action:boolean,launch:boolean,form:boolean,embedded:boolean,pages:int>"
BRAND = "struct<name:string,locale:string,method:string,score:double,official:boolean>"
OPINION = "struct<verdict_opinion:string,attack_type:string,recommended_action:string,highlights:int>"
#: Every field of a mail and its type; absent text is null.
FIELDS = {
    "msg_id": "string", "org_id": "string", "from": ADDRESS, "reply_to": ADDRESS, "return_path": ADDRESS, "to_count": "int", "subject": "string", "message_id": "string",
    "mailer": "string", "has_headers": "boolean", "date": "timestamp", "text_body": "string", "html_body": "string", "ocr_text": "string", "language": "string", "spf": "string", "dkim": "string", "dmarc": "string", "auth_source": "string",
    "received": f"array<{HOP}>", "links": f"array<{LINK}>", "attachments": f"array<{ATTACHMENT}>", "images": f"array<{IMAGE}>", "pdf": PDF, "brand": BRAND, "llm": OPINION,
}
SIGNAL = "struct<id:string,category:string,weight:double,confidence:double,evidence:string,source:string>"


def as_mail(df: DataFrame, *also: str) -> DataFrame:
    """``df`` as every field of a mail in its type and the columns ``also``; missing fields are null, arrays never."""
    cols = []
    for name, kind in FIELDS.items():
        c = F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)
        cols.append((F.coalesce(c, F.array().cast(kind)) if kind.startswith("array") else c).alias(name))
    return df.select(*cols, *also)
