"""Registered query of operator 2."""

from . import chat
from . import common as C


def op2_chat_format(spark, sf_dir):
    out = chat.format_chats(C.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.drop("text")


QUERIES = {"op2_chat_format": op2_chat_format}
