"""Queries of this subpackage, by name, and the SQL for those that SQL can express."""

from . import decontaminate, htmltext, kneser_ney, lattice, license_scan, mixing, ogg, secrets, simhash, toxicity


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_lattice_score": lattice.query,
        "op2_html_template": htmltext.query,
        "op3_toxicity": toxicity.query,
        "op4_kn_quality": kneser_ney.query,
        "op5_secret_scan": secrets.query,
        "op6_license_scan": license_scan.query,
        "op7_source_mix": mixing.query,
        "op8_ogg_media": ogg.query,
        "op9_decontaminate": decontaminate.query,
        "op10_simhash": simhash.query,
        "pipeline": _pipeline,
    }


def oracle_sql():
    return {"op5_secret_scan": secrets.SQL, "op7_source_mix": mixing.SQL, "op9_decontaminate": decontaminate.SQL}
