"""The model for added spans on forms and phrases that no fit has seen, inside sentences of the test tables' texts."""

from pyspark.sql import functions as F

from kerbline.llm import pii

#: As pii.FORMS: phrases and forms of personal data, then of look-alikes; none is in the lists that the model learned from.
UNSEEN = {
    "written_email": (
        ("drop a line to ", "replies go to ", "you can contact me via e-mail, ", "mail the editor, "),
        ("%%%%%_%%%% [at] %%%%%% [dot] org", "%%%%%%(at)%%%%%%%(dot)net", "%%%%%%% at %%%%% dot com", "%%% [at] %%%%%%%%% [dot] info"),
        ("the ship lay ", "he was good ", "prices were up ", "a painting "),
        ("%%%% at %%%%%% dot and dash", "%%%%%%% at %%%% dot by dot"),
    ),
    "local_phone": (
        ("give me a call on ", "the landline is ", "mobile: ", "phone number ", "our fax is "),
        ("### ###-####", "(###)###-####", "###-### ####", "###.###.####"),
        ("the code reads ", "build ", "chapter and verse ", "shelf ", "weights of "),
        ("### ### ####", "###.###.####", "###-###-####"),
    ),
    "social_number": (
        ("her social security no. is ", "SSN of the widow: ", "social security: "),
        ("###-##-####",),
        ("invoice ", "item ", "catalogue ", "case ", "the plate read "),
        ("###-##-####",),
    ),
    "bank_account": (
        ("please wire it to IBAN ", "the account number is ", "bank account "),
        ("@@## #### #### #### #### ####", "@@##@@@@########", "@@## @@@@ #### #### ####"),
        ("engine ", "batch ", "voucher ", "firmware "),
        ("@@## @#@@ @@@@ #@@@", "@@##@@@#@@@#@@@@@"),
    ),
    "digit_run": (
        ("passport number ", "tax id: ", "her account is ", "phone no. "),
        ("##########", "#########", "###########"),
        ("inode ", "timestamp ", "votes ", "bytes read "),
        ("#############", "########", "#################"),
    ),
}


def test_unseen_forms_and_phrases(spark, data, monkeypatch):
    pii.model()  # fitted on its own lists before they are replaced
    monkeypatch.setattr(pii, "FORMS", UNSEEN)
    lines = [r.s for r in spark.read.parquet(f"{data}/documents.parquet").select(F.explode(F.split("text", r"(?<=\.)\s")).alias("s")).where(~F.col("s").rlike("[0-9@]") & F.length("s").between(20, 200)).orderBy(F.xxhash64("s")).limit(200).collect()]
    around = lambda salt: F.element_at(F.array(*map(F.lit, lines)), F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(lines))).cast("int") + 1)
    d = pii.labelled_texts(spark, 3000, seed=77).withColumn("text", F.concat_ws(" ", around("a"), "text", around("b")))
    got = pii.find(d, "text", ("generator", "y")).selectExpr("generator", "y", "size(more) > 0 OR size(base) > 0 AS hit").groupBy("generator").agg(
        F.count_if(F.col("hit") & (F.col("y") == 1)).alias("tp"), F.count_if("hit").alias("p"), F.sum("y").alias("y")
    ).collect()
    rates = {pii.GENERATORS[r.generator][0]: (round(r.tp / max(1, r.p), 3), round(r.tp / r.y, 3)) for r in got}
    print(rates)
    assert sum(r.tp for r in got) / sum(r.p for r in got) >= 0.9, rates
    assert sum(r.tp for r in got) / sum(r.y for r in got) >= 0.4, rates
