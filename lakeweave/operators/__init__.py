"""lakeweave.operators"""
