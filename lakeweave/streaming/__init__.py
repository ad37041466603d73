"""lakeweave.streaming"""
