"""Column contracts of the tables and JSON documents."""

OPTION = "struct<label:string,text:string>"
QUESTION = (f"id string, sourceNumber string, category string, stem string, options array<{OPTION}>, "
            "answer array<string>, answerPending boolean, draftAnswer array<string>, multiple boolean, "
            "examProfile string, examYear int, examFormat string, questionType string, points double, "
            "sharedOptionGroup string, explanation string, answerSource string")


def _struct(columns: str) -> str:
    """``a int, b string`` as ``struct<a:int,b:string>`` (top-level names only)."""
    out, depth = "", 0
    pending = True
    for ch in columns:
        depth += (ch in "<(") - (ch in ">)")
        if ch == " " and depth == 0:
            if pending and out and not out.endswith(","):
                out, pending = out + ":", False
            continue
        if ch == "," and depth == 0:
            pending = True
        out += ch
    return f"struct<{out}>"


QUESTION_STRUCT = _struct(QUESTION)
BANK_PACKAGE = (f"format string, version int, exportedAt string, report string, "
                f"bank struct<name:string,description:string,groupName:string,questions:array<{QUESTION_STRUCT}>>")

ENGLISH_QUESTION = f"struct<id:string,number:string,stem:string,options:array<{OPTION}>,answer:string,explanation:string>"
ENGLISH_SECTION = ("struct<id:string,kind:string,title:string,part:string,directions:string,passage:string,"
                   f"questions:array<{ENGLISH_QUESTION}>>")
ENGLISH_TEST = (f"struct<name:string,stage:string,examVariant:string,sourceFormat:string,usedOcr:boolean,"
                f"aiImported:boolean,answerSourceName:string,sections:array<{ENGLISH_SECTION}>>")
ENGLISH_PACKAGE = f"format string, exportedAt string, test {ENGLISH_TEST}"

RECORD_EXPORT = "product string, version int, exportedAt string, user_id string, state string"

LEDGER = "user_id string, question_id string, field string, value string, updated_at bigint, seq bigint"
BANKS = "id string, name string, description string, group_name string, featured boolean, imported_at string, updated_at string"
COMMENTS = ("id string, user_id string, question_id string, nickname string, body string, status string, "
            "moderation_reason string, created_at timestamp, updated_at timestamp")
