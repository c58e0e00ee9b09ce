import pytest
from pyspark.sql import functions as F

from provlake.operators import titles

URLS = {
    "neurips": ("https://proceedings.neurips.cc/paper/2020/hash/ab-Abstract.html", "https://proceedings.neurips.cc/paper_files/paper/2020/file/ab-Paper.pdf"),
    "neurips_track": ("https://proceedings.neurips.cc/paper_files/paper/2022/hash/ab-Abstract-Conference.html?x=1", "https://proceedings.neurips.cc/paper_files/paper/2022/file/ab-Paper-Conference.pdf"),
    "iclr": ("https://proceedings.iclr.cc/paper_files/paper/2024/hash/ab-Abstract-Conference.html", "https://proceedings.iclr.cc/paper_files/paper/2024/file/ab-Paper-Conference.pdf"),
    "jmlr": ("https://www.jmlr.org/papers/v21/20-074.html", "https://www.jmlr.org/papers/volume21/20-074/20-074.pdf"),
    "jmlr_other": ("https://jmlr.org/tmlr/a.html#top", "https://jmlr.org/tmlr/a.pdf"),
    "cvf": ("https://openaccess.thecvf.com/content/CVPR2021/html/A_paper.html", "https://openaccess.thecvf.com/content/CVPR2021/papers/A_paper.pdf"),
    "springer": ("https://link.springer.com/article/10.1007/s1-2?error=x", "https://link.springer.com/content/pdf/10.1007/s1-2.pdf"),
    "springer_chapter": ("https://link.springer.com/chapter/10.1007/978-3_4", "https://link.springer.com/content/pdf/10.1007/978-3_4.pdf"),
    "pnas": ("https://www.pnas.org/doi/full/10.1073/pnas.1", "https://www.pnas.org/doi/pdf/10.1073/pnas.1"),
    "science": ("https://www.science.org/doi/abs/10.1126/science.a#s", "https://www.science.org/doi/pdf/10.1126/science.a"),
    "frontiers": ("https://www.frontiersin.org/articles/10.3389/f.1/full?x", "https://www.frontiersin.org/articles/10.3389/f.1/pdf"),
    "mdpi": ("https://www.mdpi.com/1/2/3/htm", "https://www.mdpi.com/1/2/3/pdf"),
    "mdpi_page": ("https://www.mdpi.com/1/2/3/?type=x", "https://www.mdpi.com/1/2/3/pdf"),
    "none": ("https://example.org/a.html", None),
    "unchanged": ("https://proceedings.neurips.cc/about", None),
}


@pytest.mark.parametrize("name", URLS)
def test_record_pages(spark, name):
    url, pdf = URLS[name]
    assert spark.createDataFrame([(url,)], "url string").select(titles.pdf_url(F.col("url"))).first()[0] == pdf
