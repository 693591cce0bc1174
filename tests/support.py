"""What several test modules share."""

SF = "/root/testdata/sf0.001"
