"""Line records from streams of text files."""
